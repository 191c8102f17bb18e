"""Variant spellings of names: a prefix-filtered set-similarity join on token q-grams, verified by soft weighted token similarity.

Reading. A spelling is read into tokens, full or abbreviated, and its kind. Every token gets a weight by the inverse of the
number of spellings that hold it, so that rare tokens count more. One of a person's tokens is the core (the surname): commas,
initials and capitals tell which, and else a table of how often each token stands as a given name where these tell; of an
organisation it is the rarest word. Spellings with the same reading are one signature, however many there are.

Joining. Cores, and all words of organisations, are joined by their sets of q-grams: in ascending order of frequency, only
the prefix that any pair at the threshold must share, within lengths that allow it. Two signatures meet if their cores, or
one of the rarest words of an organisation and any of the other's, are such a pair and their first further tokens may agree: these are keyed by the beginning and the end of every form of the name, so that one
edit anywhere, the first letter included, leaves a key in common, and by the first letter where one of them is abbreviated.

Verifying. The score of two signatures is the mean of their tokens' similarities, each weighted by the lesser weight of
the two, a contradiction counting against; it must reach LEAST. What two signatures link to a third alike is linked too, if
they score as much with one edit more allowed.

Defined results: null and blank names are no spellings; a name without letters matches nothing; repeated rows are one
spelling; a name that is a single token is its own core without further tokens, and means the same as others of that reading.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import BLANKS

#: Least Jaccard similarity of the q-gram sets of two cores.
THRESHOLD = 0.4
Q = 2
#: Least score of two signatures that mean the same, of persons and of organisations.
LEAST = {"person": 0.6, "organisation": 0.75}
#: What a contradiction counts, against a similarity of 0 to 1.
AGAINST = -2.0
#: Edits allowed in a core and what it is worth with none, one or two.
CORE = (1.0, 0.85, 0.7)

#: Titles and degrees, name particles, words of organisations with their abbreviations.
TITLES = frozenset("dr prof professor mrs phd msc mph dphil sir dame".split())
PARTICLES = frozenset("van von der den de da del della di dos du la le el al bin ibn ten ter zu zum af av".split())
ORGANISATION = {
    "university": "university", "univ": "university", "institute": "institute", "inst": "institute", "consortium": "consortium", "consort": "consortium", "cons": "consortium", "research": "research", "res": "research",
    "group": "group", "grp": "group", "network": "network", "netw": "network", "collaboration": "collaboration", "collab": "collaboration", "centre": "centre", "center": "centre", "ctr": "centre",
    "society": "society", "soc": "society", "committee": "committee", "council": "council", "foundation": "foundation", "association": "association", "assoc": "association", "laboratory": "laboratory",
    "lab": "laboratory", "department": "department", "dept": "department", "hospital": "hospital", "hosp": "hospital", "college": "college", "coll": "college", "initiative": "initiative", "trial": "trial", "study": "study",
}
FILLERS = frozenset("of for the and on in at".split())
#: Familiar forms of given names and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "andy": "andrew", "drew": "andrew", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "beppe": "giuseppe", "bella": "isabella",
    "izzy": "isabella", "bess": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "bill": "william", "billy": "william", "will": "william", "liam": "william",
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "charlie": "charles", "chuck": "charles", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "dick": "richard",
    "rick": "richard", "rich": "richard", "richie": "richard", "dima": "dmitri", "mitya": "dmitri", "dolly": "dorothea", "dora": "dorothea", "dot": "dorothea", "thea": "dorothea", "lola": "dolores", "ed": "edward", "eddie": "edward", "ned": "edward",
    "ted": "edward", "teddy": "edward", "ellie": "eleanor", "nora": "eleanor", "nell": "helena", "lena": "helena|magdalena", "fran": "francesca", "franca": "francesca", "fanny": "francesca", "fred": "frederick", "freddy": "frederick", "gabby": "gabriella",
    "gaby": "gabriella", "gert": "gertrude", "trudy": "gertrude", "greg": "gregory", "hal": "henry", "harry": "henry", "hank": "henry", "jack": "john", "johnny": "john", "jim": "james", "jimmy": "james", "jamie": "james", "jo": "josephine",
    "josie": "josephine", "joe": "joseph", "joey": "joseph", "pepe": "jose", "kate": "katherine", "katie": "katherine", "kathy": "katherine", "kay": "katherine", "katya": "ekaterina", "katja": "ekaterina", "larry": "lawrence", "len": "leonard",
    "leo": "leonardo", "lou": "louis", "mila": "ludmila", "luda": "ludmila", "lyuda": "ludmila", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "magda": "magdalena", "matt": "matthias", "max": "maximilian", "mike": "michael", "mick": "michael",
    "misha": "mikhail", "nat": "natalia", "natasha": "natalia", "nick": "nicholas", "nico": "nicholas", "klaus": "nicholas", "olly": "oliver", "pat": "patricia|patrick", "patty": "patricia", "pete": "peter", "pip": "philippa", "pippa": "philippa", "phil": "philip", "becky": "rebecca", "becca": "rebecca",
    "ron": "ronald", "ronnie": "veronica", "vera": "veronica", "sam": "samuel", "seb": "sebastian", "bastian": "sebastian", "steve": "stephen", "sue": "susanna", "susie": "susanna", "suzy": "susanna", "theo": "theodore", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "toby": "tobias", "tobi": "tobias", "uli": "ulrike",
    "ulli": "ulrike", "val": "valentina", "valya": "valentina", "vicky": "victoria", "tori": "victoria", "vince": "vincent", "wim": "willem", "bas": "sebastian", "matti": "matthias", "tavi": "octavia", "gail": "abigail", "hanna": "johanna", "hannah": "johanna", "tasha": "natalia", "gabi": "gabriella", "trudi": "gertrude", "xavi": "xavier", "paco": "francisco", "connie": "constance",
    "mina": "wilhelmina", "zach": "zachary", "zack": "zachary", "zhenya": "yevgenia", "zosia": "zofia", "genia": "yevgenia",
}
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"})


def fold(text: str) -> str:
    """Lower case without diacritics; ligatures and barred letters as plain ones."""
    low = unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS)).translate(_LETTERS)
    return "".join(c for c in low if not unicodedata.combining(c))


def close(a: str, b: str, most: int = 1) -> bool:
    """At most `most` insertions, deletions, substitutions or swaps of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if max(len(a), len(b)) > 3 * most + 2:
        return False
    old, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if old and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, old[j - 2] + 1)
            new.append(v)
        old, row = row, new
    return row[-1] <= most


def read(name: str) -> dict | None:
    """kind (person, organisation), tokens [(text, shape)] and the core's position if the form tells it (-1 if not).

    Shapes: full, part (abbreviated by a full stop), initials. Particles are dropped from the tokens.
    """
    bare = re.sub(r"[’'`´]", "", name)
    chunks = [c.strip() for c in bare.split(",")]
    chunks = [c for c in chunks if c and fold(c.replace(".", "")) not in TITLES]
    raw = [(t, k) for k, c in enumerate(chunks) for t in c.split()]
    raw = [(t, k) for t, k in raw if fold(t.replace(".", "")) not in TITLES or len(raw) == 1]
    plain = [fold(re.sub(r"[^\w-]", "", t)).strip("-") for t, _ in raw]
    if not any(plain):
        return None
    if any(_org(p) for p in plain) and len(raw) > 1:
        words = [_org(p) or p for p in plain if p and p not in FILLERS]
        proper = [i for i, w in enumerate(words) if w not in ORGANISATION.values()]
        return {"kind": "organisation", "tokens": [(w, "full") for w in words], "core": proper[0] if proper else 0}
    tokens, core, comma = [], -1, len(chunks) > 1
    for n, ((t, chunk), p) in enumerate(zip(raw, plain)):
        if not p or (p in PARTICLES and len(raw) > 2 and not t.endswith(".") and not (t.isupper() and n == len(raw) - 1)):
            continue
        letters = re.sub(r"[^\w]", "", t)
        short = len(letters) <= 4 and letters.isupper() or len(letters) == 1
        last = n == len(raw) - 1
        if t.endswith(".") and len(letters) > 1 and not letters.isupper():
            shape = "part"
        elif (short or (last and len(letters) <= 2)) and len(raw) > 1:
            shape = "initials"
        else:
            shape = "full"
        if comma and chunk == 0 and shape == "full":
            core = len(tokens)
        elif not comma and shape == "full" and letters.isupper() and len(letters) > 3:
            core = len(tokens)
        tokens.append((p, shape))
    full = [i for i, (_, s) in enumerate(tokens) if s == "full"]
    if core < 0 and len(full) == 1:
        core = full[0]
    if not tokens:
        return None
    return {"kind": "person", "tokens": tokens, "core": core if full else 0}


_ORG_WORDS = frozenset(ORGANISATION.values())
_ORG_FULL = sorted({v for v in ORGANISATION.values() if len(v) > 6})


def _org(p: str) -> str | None:
    """The word of an organisation that p is, long ones with a typo too."""
    if p in ORGANISATION:
        return ORGANISATION[p]
    return next((w for w in _ORG_FULL if abs(len(w) - len(p)) < 3 and len(p) > 5 and close(w, p, 2)), None) if len(p) > 5 else None


def core_of(parsed: dict, given: list[bool], weights: list[float]) -> int:
    """Position of the core: as the form tells; else of a person's full tokens the last that is no given name, of an organisation's words
    the rarest, words for kinds of organisations last, the smallest of equally rare ones."""
    if parsed["kind"] == "organisation":
        words = [t for t, _ in parsed["tokens"]]
        return min(range(len(words)), key=lambda i: (words[i] in _ORG_WORDS, -round(weights[i], 9), words[i]))
    if parsed["core"] >= 0:
        return parsed["core"]
    full = [i for i, (_, s) in enumerate(parsed["tokens"]) if s == "full"]
    rare = [i for i in full if not given[i]]
    return rare[-1] if rare else full[-1]


def forms(token: str) -> set[str]:
    """The token and the given names that it is a familiar form of."""
    return {token, *NICKNAMES[token].split("|")} if token in NICKNAMES else {token}


def heads(kind: str, core: str, rest: list[tuple[str, str]], weights: list[float]) -> tuple[list[str], list[str]]:
    """Tokens by which a signature looks for others, and by which it is found: a person's core; of an organisation the rarest
    words, so many that the others weigh too little to reach LEAST without one of them, and all words."""
    if kind == "person":
        return [core], [core]
    words = sorted(zip(weights, [core, *(t for t, _ in rest)]), reverse=True)
    spare, asks = sum(weights) * (1 - LEAST[kind]), []
    for w, t in words:
        asks.append(t)
        spare -= w
        if spare < 0:
            break
    return asks, sorted({t for _, t in words})


def edit_keys(token: str) -> set[str]:
    """The first three letters, and what follows the first three and four: of two tokens an edit apart either the beginnings agree, or the edit
    is among the first letters and leaves an end of both alike."""
    return {"b" + token[:3], "e" + token[3:], "e" + token[4:]}


def meeting_keys(kind: str, rest: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Keys under which a signature looks for others of a similar core, and keys under which it is found.

    Full tokens look for full ones by beginning and end of every form; abbreviated ones look for all by first letter.
    """
    if kind == "organisation" or not rest:
        return ["*"], ["*"]
    t, shape = rest[0]
    heads = {t, t.replace("-", ""), t.split("-")[0]} - {""}
    found = {"i" + f[0] for h in heads for f in forms(h)}
    if shape != "full":
        return sorted({"i" + h[0] for h in heads}), sorted(found)
    own = {k for h in heads for f in forms(h) for k in edit_keys(f)}
    return sorted(own), sorted(own | found)


def _given(a: tuple[str, str], b: tuple[str, str], slack: int) -> float:
    """Agreement of two further tokens, -1 if they contradict."""
    (x, sx), (y, sy) = a, b
    x, y = x.replace("-", ""), y.replace("-", "")
    fx, fy = forms(x), forms(y)
    if sx == sy == "full":
        if x == y:
            return 1.0
        if fx & fy:
            return 0.9
        if min(len(x), len(y)) > 2 and any(close(u, v, slack) for u in fx for v in fy if min(len(u), len(v)) > 2 * slack):
            return 0.8
        return 0.7 if _short(x, y) or _short(y, x) else -1.0
    long, short = (fx, y) if len(x) >= len(y) else (fy, x)
    if any(v.startswith(short) for v in long):
        return 0.5 + 0.4 * (len(short) > 1)
    if "part" in (sx, sy) and len(short) > 2 and any(v[0] == short[0] and close(v[:n], short) for v in long for n in (len(short) - 1, len(short), len(short) + 1)):
        return 0.6
    return -1.0


def _short(x: str, y: str) -> bool:
    """Whether x is the start of y with a familiar ending, as Gabi of Gabriella."""
    m = re.fullmatch(r"(\w{3,}?)\w?(?:i|y|ie)", x)
    return bool(m) and len(y) > len(x) and y.startswith(m.group(1))


def edits(a: str, b: str, most: int) -> int | None:
    """How many edits two tokens are apart, None for more than `most`."""
    return next((n for n in range(most + 1) if close(a, b, n)), None)


def same(a: dict, b: dict, slack: int = 1) -> bool:
    """Whether two signatures (kind, core, rest, weight of the core, weights of the rest) mean the same: whether their score reaches LEAST.

    slack: edits allowed in a token, 2 if a third signature links both.
    """
    return a["kind"] == b["kind"] and score(a, b, slack) >= LEAST[a["kind"]]


def score(a: dict, b: dict, slack: int = 1) -> float:
    """Mean similarity of the tokens of two signatures, each counting by the lesser of its weights; -1 if the cores differ."""
    if a["kind"] == "organisation":
        return _mean(_words(a, b))
    apart = 0 if a["core"] == b["core"] else edits(a["core"], b["core"], slack) if min(len(a["core"]), len(b["core"])) > 3 else None
    if apart is None:
        return -1.0
    weight = min(a["weight"], b["weight"])
    head = (weight * CORE[apart], weight)
    if not a["rest"] or not b["rest"]:
        lone = [(0.0, w[0]) for w in (a["weights"], b["weights"]) if w]
        return _mean([head, *lone])
    return max(_mean([head, *_aligned(p, q, slack)]) for p in spread(a["rest"], a["weights"]) for q in spread(b["rest"], b["weights"]))


def _mean(parts: list[tuple[float, float]]) -> float:
    return sum(v for v, _ in parts) / max(sum(w for _, w in parts), 1e-9)


def _aligned(p: list, q: list, slack: int) -> list[tuple[float, float]]:
    """Value and weight of each two further tokens in order; those that one name alone has say nothing."""
    out = []
    for (m, u), (n, v) in zip(p, q):
        s, w = _given(m, n, slack), min(u, v)
        out.append(((AGAINST if s < 0 else s) * w, w))
    return out


def _words(a: dict, b: dict) -> list[tuple[float, float]]:
    """Value and weight of the words of two organisations, in any order; a word against another contradicts, one more or less is missing."""
    own, left = ([(x["core"], x["weight"]), *zip((t for t, _ in x["rest"]), x["weights"])] for x in (a, b))
    out, alone = [], []
    for t, w in sorted(own, key=lambda x: -x[1]):
        hit = next((x for x in left if x[0] == t), None)
        worth = 1.0
        if not hit:
            # of few words none may be more than an edit off
            most = 1 + (len(t) > 6 and min(len(a["rest"]), len(b["rest"])) > 2)
            hit, worth = next((x for x in left if min(len(x[0]), len(t)) > 3 and close(t, x[0], most)), None), 0.9
        if hit:
            left.remove(hit)
            out.append((worth * min(w, hit[1]), min(w, hit[1])))
        else:
            alone.append(w)
    rest = [w for _, w in left]
    out += [(AGAINST * min(x, y), min(x, y)) for x, y in zip(alone, rest)]
    more = alone[len(rest) :] + rest[len(alone) :]
    return out + [(0.0, w) for w in more]


def joined(a: dict, b: dict) -> bool:
    """Whether two signatures that both mean the same as a third, whose first further token is full, mean the same: they do
    unless their cores differ or full tokens contradict; abbreviations may differ, as the third explains both."""
    if a["kind"] != b["kind"] or a["kind"] == "person" and not close(a["core"], b["core"], 2):
        return False
    if a["rest"] and b["rest"] and "full" == a["rest"][0][1] == b["rest"][0][1] or a["kind"] == "organisation":
        return same(a, b, 2)
    return bool(a["rest"] and b["rest"])


def spread(rest: list[tuple[str, str]], weights: list[float]) -> list[list[tuple[tuple[str, str], float]]]:
    """Further tokens with weights: initials written together as single ones; where a full token has a hyphen, also the reading with its parts apart."""
    one, two = [], []
    for (t, s), w in zip(rest, weights):
        units = [((c, "initials"), w) for c in t if c != "-"] if s == "initials" else [((t, s), w)]
        one += units
        two += [((c, s), w) for c in t.split("-") if c] if s == "full" and "-" in t else units
    return [one] if one == two else [one, two]


# ---- over tables ----


def openalex_names(responses: DataFrame) -> DataFrame:
    """name: author display names of search results."""
    return responses.select(F.explode("search.results").alias("w")).select(F.explode("w.authorships").alias("a")).select(F.trim("a.author.display_name", F.lit(BLANKS)).alias("name"))


def epmc_names(responses: DataFrame) -> DataFrame:
    """name: the elements of authorString of the results; texts that are not complete JSON give none."""
    from lodestrata.operators.shredding import epmc_works

    text = F.regexp_replace("authorString", r"\.\s*$", "")
    return epmc_works(responses.select("response_id", "search")).select(F.explode(F.split(text, "[,;]")).alias("n")).select(F.trim("n", F.lit(BLANKS)).alias("name"))


def spellings(names: DataFrame) -> DataFrame:
    """The distinct non-blank names, spread over all cores: they are few bytes but costly to read."""
    return names.filter("name is not null and name <> ''").distinct().repartition(_tasks(names))


def _tasks(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


_READ = "name string, kind string, tokens array<string>, core int"
_SIGNED = "name string, signature string, kind string, core string, weight double, rest array<string>, weights array<double>, asks array<string>, answers array<string>, asked array<string>, known array<string>"


def _join(tokens: list[tuple[str, str]]) -> list[str]:
    return [f"{s}:{t}" for t, s in tokens]


def _part(tokens) -> list[tuple[str, str]]:
    return [(t.partition(":")[2], t.partition(":")[0]) for t in tokens]


def weighed(parsed: DataFrame) -> DataFrame:
    """parsed with `weights` and `given` of its tokens, in their order, from a table of all tokens.

    A token's weight is ln(1 + spellings / spellings with it). It is a given name if, of the spellings of persons that tell
    the core by their form, more have it beside the core than as it, and more than one.
    """
    rows = parsed.select("name", "core", "kind", F.posexplode("tokens").alias("i", "t"))
    told = (F.col("kind") == "person") & (F.col("core") >= 0) & F.col("t").startswith("full:")
    beside, own = F.count_if(told & (F.col("i") != F.col("core"))), F.count_if(told & (F.col("i") == F.col("core")))
    known = rows.groupBy("t").agg(F.count_distinct("name").alias("df"), ((beside > own) & (beside > 1)).alias("given"))
    total = F.lit(parsed.count())
    back = rows.join(known, "t").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", "df", "given"))).alias("k"))
    one = parsed.join(back, "name")
    return one.select("name", "kind", "tokens", "core", F.transform("k", lambda x: F.log1p(total / x["df"])).alias("weights"), F.col("k.given").alias("given"))


def signed(names: DataFrame, scratch) -> DataFrame:
    """Each spelling with its signature and the keys of it."""

    def reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, p["kind"], _join(p["tokens"]), p["core"] if p["kind"] == "person" else -1) for n in b["name"] if (p := read(n))]
            yield pd.DataFrame(rows, columns=["name", "kind", "tokens", "core"])

    def settling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, kind, tokens, core, weights, given in zip(b["name"], b["kind"], b["tokens"], b["core"], b["weights"], b["given"]):
                parts = _part(tokens)
                at = core_of({"kind": kind, "tokens": parts, "core": core}, list(given), list(weights))
                own, rest = parts[at][0].replace("-", ""), [t for i, t in enumerate(parts) if i != at]
                if kind == "organisation":  # their words may stand in any order
                    order = sorted(range(len(rest)), key=lambda i: rest[i])
                    others = [w for i, w in enumerate(weights) if i != at]
                    rest, w = [rest[i] for i in order], [others[i] for i in order]
                else:
                    w = [x for i, x in enumerate(weights) if i != at]
                asks, answers = meeting_keys(kind, rest)
                rows.append((n, "|".join([kind, own, *_join(rest)]), kind, own, weights[at], _join(rest), w, asks, answers, *heads(kind, own, rest, [weights[at], *w])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SIGNED.split(", ")])

    parsed = scratch.table(names.mapInPandas(reading, _READ))
    return scratch.table(weighed(parsed).repartition(_tasks(names)).mapInPandas(settling, _SIGNED))


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """a, b: tokens (column core) equal or with q-gram sets THRESHOLD alike and at most two edits apart, both ways round; by prefix filter."""
    cores = tokens.select("core").distinct()
    padded = F.concat(F.lit("^"), "core", F.lit("$"))
    grams = cores.select("core", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("core") + 3 - Q), lambda i: F.substring(padded, i, F.lit(Q))))).alias("g"))
    often = grams.groupBy("g").agg(F.count("*").alias("n"))
    ranked = grams.join(often, "g").groupBy("core").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("gs"))
    size = F.size("gs")
    # two edits leave all but 2 Q of either set's q-grams, so that many and one more are as good a prefix
    enough = F.least(size - F.ceil(size * THRESHOLD).cast("int") + 1, F.lit(2 * Q + 1))
    prefix = ranked.select("core", size.alias("size"), F.explode(F.slice(F.col("gs.g"), F.lit(1), enough)).alias("g"))
    # of lengths more than two apart none can be near: the length is part of the key
    x = prefix.select(F.col("core").alias("a"), F.col("size").alias("n"), "g", F.length("core").alias("l"))
    y = prefix.select(F.col("core").alias("b"), F.col("size").alias("m"), "g", F.explode(F.sequence(F.length("core") - 2, F.length("core") + 2)).alias("l"))
    near = (F.col("a") < F.col("b")) & (F.col("n") >= F.col("m") * THRESHOLD) & (F.col("m") >= F.col("n") * THRESHOLD)
    pairs = x.join(y, ["g", "l"]).filter(near).filter(F.levenshtein("a", "b", 2) >= 0).select("a", "b").distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(cores.select(F.col("core").alias("a"), F.col("core").alias("b")))


_SIDE = ("core", "weight", "rest", "weights")


def _verified(pairs: DataFrame, agree) -> DataFrame:
    """a, b of the pairs of signatures (kind, a, b, and the columns of _SIDE of either) that agree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            side = lambda s: [dict(zip(("kind", *_SIDE), v)) | {"rest": _part(v[3]), "weights": list(v[4])} for v in zip(b["kind"], *(b[f"{c}_{s}"] for c in _SIDE))]  # noqa: B023, E731
            keep = [agree(x, y) for x, y in zip(side("a"), side("b"))]
            yield b.loc[keep, ["a", "b"]]

    slim = pairs.select("kind", "a", "b", *(f"{c}_{s}" for s in "ab" for c in _SIDE)).repartition(_tasks(pairs))
    return slim.mapInPandas(run, "a string, b string")


def linked(signatures: DataFrame, scratch) -> DataFrame:
    """a, b (a < b): pairs of signatures (signature, kind, _SIDE, asks, answers; one row each) that mean the same."""
    side = lambda s: signatures.select(F.col("signature").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in _SIDE))
    near = scratch.table(similar_tokens(signatures.select(F.explode("known").alias("core"))))
    asks = signatures.select("kind", "asks", F.col("signature").alias("x"), F.explode("asked").alias("a")).select("kind", "a", "x", F.explode("asks").alias("key"))
    answers = signatures.select("kind", "answers", F.col("signature").alias("y"), F.explode("known").alias("b")).select("kind", "b", "y", F.explode("answers").alias("key"))
    met = asks.join(near, "a").join(answers, ["kind", "b", "key"]).filter("x <> y")
    met = met.select("kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    direct = scratch.table(_verified(met.join(side("a"), "a").join(side("b"), "b"), same))
    # signatures linked to a third alike, by two typos or a familiar form in a row
    third = signatures.filter((F.col("kind") == "organisation") | F.try_element_at("rest", F.lit(1)).startswith("full:")).select(F.col("signature").alias("x"), "kind")
    ends = direct.select(F.col("a").alias("x"), F.col("b").alias("y")).union(direct.select("b", "a")).join(third, "x")
    hops = ends.select("kind", "x", F.col("y").alias("a")).join(ends.select("x", F.col("y").alias("b")), "x").filter("a < b").select("kind", "a", "b").distinct()
    more = _verified(hops.join(direct, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b"), joined)
    return scratch.table(direct.unionByName(more))


def link(names: DataFrame) -> DataFrame:
    """name_a, name_b (the smaller first by code points): the pairs of spellings that mean the same person or organisation.

    Signatures are linked, never spellings; the pairs of spellings are those of linked signatures and of each signature's own.
    """
    from lodestrata.session import Scratch

    scratch = Scratch(names.sparkSession, "names")
    table = signed(spellings(names), scratch)
    pairs = linked(_signatures(table), scratch)
    own = table.select("name", "signature")
    x, y = own.select(F.col("name").alias("n"), F.col("signature").alias("a")), own.select(F.col("name").alias("m"), F.col("signature").alias("b"))
    across = pairs.join(x, "a").join(y, "b").select("n", "m")
    within = x.join(y.withColumnRenamed("b", "a"), "a").filter("n < m").select("n", "m")
    return across.unionByName(within).select(F.least("n", "m").alias("name_a"), F.greatest("n", "m").alias("name_b")).distinct()


def classes(names: DataFrame) -> DataFrame:
    """name, class (the smallest spelling of its signature), n_spellings of that, n_linked other classes: one row per spelling."""
    from lodestrata.session import Scratch

    scratch = Scratch(names.sparkSession, "names")
    table = signed(spellings(names), scratch)
    pairs = linked(_signatures(table), scratch)
    links = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("signature")).agg(F.count("*").alias("n_linked"))
    per = table.groupBy("signature").agg(F.min("name").alias("class"), F.count("*").alias("n_spellings")).join(links, "signature", "left")
    return table.select("name", "signature").join(per, "signature").select("name", "class", "n_spellings", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def _signatures(table: DataFrame) -> DataFrame:
    """One row per signature; of different weights of one reading (as hyphens are dropped from cores) the least."""
    return table.groupBy("signature").agg(F.min("kind").alias("kind"), F.min("core").alias("core"), F.min("weight").alias("weight"), F.min("rest").alias("rest"), F.min("weights").alias("weights"), F.min("asks").alias("asks"), F.min("answers").alias("answers"), F.min("asked").alias("asked"), F.min("known").alias("known"))
