"""Deeply nested records to related flat tables, by columnar shredding.

Every leaf path becomes a column of values with a repetition level (at which repeated ancestor this entry repeats, 0 for
a new record) and a definition level (how much of the path is there). A table of a repeated ancestor is then rebuilt from
the level sequences alone: rows start where the repetition level is at most the ancestor's, positions are run lengths
between lower repetition levels, and an object exists where the definition level reaches its own. All steps are numpy
operations over whole Arrow batches; nothing is shuffled and no row is visited in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


@dataclass
class Leaf:
    """A leaf's level sequences; index points into `values`, or is -1 where the path ends early."""

    path: tuple[str, ...]
    rep: np.ndarray
    deff: np.ndarray
    index: np.ndarray
    values: pa.Array
    defined: dict[tuple[str, ...], int] = field(default_factory=dict)  # level from which the object at a prefix is there
    slots: dict[tuple[str, ...], tuple[int, int]] = field(default_factory=dict)  # repeated prefix: its repetition level, and the definition level of an element, null or not


def _valid(array: pa.Array) -> np.ndarray:
    return array.is_valid().to_numpy(zero_copy_only=False)


def shred(array: pa.Array, name: str) -> list[Leaf]:
    """The leaves of a nested column, in order of the schema; paths name lists once ("results"), not their elements."""
    n = len(array)
    out: list[Leaf] = []
    _shred(array, (name,), np.zeros(n, np.int16), np.zeros(n, np.int16), np.arange(n), 0, 0, {}, {}, out)
    return out


def _shred(array, path, rep, deff, index, r, d, defined, slots, out):
    live = index >= 0
    valid = np.zeros(len(index), bool)
    valid[live] = _valid(array)[index[live]]
    kind = array.type
    if pa.types.is_struct(kind):
        here = defined | {path: d + 1}
        for k in range(kind.num_fields):
            _shred(array.field(k), (*path, kind.field(k).name), rep, deff + valid, np.where(valid, index, -1), r, d + 1, here, slots, out)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        offsets = array.offsets.to_numpy()
        start, size = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        at = index[valid]
        start[valid], size[valid] = offsets[at], offsets[at + 1] - offsets[at]
        entries = np.maximum(size, 1)
        src = np.repeat(np.arange(len(index)), entries)
        nth = np.arange(len(src)) - np.repeat(np.cumsum(entries) - entries, entries)
        has = size[src] > 0
        _shred(
            array.values, path, np.where(nth > 0, r + 1, rep[src]).astype(np.int16), (deff[src] + valid[src] + has).astype(np.int16), np.where(has, start[src] + nth, -1),
            r + 1, d + 2, defined, slots | {path: (r + 1, d + 2)}, out,
        )
    else:
        out.append(Leaf(path, rep, (deff + valid).astype(np.int16), np.where(valid, index, -1), array, defined | {path: d + 1}, dict(slots)))


def table_at(leaf: Leaf, node: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Of each non-null object at `node`, which has no repeated descendant on the leaf's path: record (row of the batch),
    one position per repeated prefix (counted over null elements too) and value (index into the leaf's values, -1 if null)."""
    levels = [(p, *v) for p, v in leaf.slots.items() if p == node[: len(p)]]
    deepest = max([r for _, r, _ in levels], default=0)
    keep = leaf.rep <= deepest
    rep, deff, index = leaf.rep[keep], leaf.deff[keep], leaf.index[keep]
    at = np.arange(len(rep))
    there = deff >= leaf.defined[node]
    out = {"record": np.cumsum(rep == 0)[there] - 1}
    for path, r, _ in levels:
        new = rep < r  # the sequence of this list starts again
        step = np.cumsum(rep == r)
        out[".".join(path)] = (step - np.maximum.accumulate(np.where(new, step, 0)))[there].astype(np.int32)
    out["value"] = index[there]
    out["at"] = at[there]
    return out


def column(leaf: Leaf, index: np.ndarray) -> pa.Array:
    """The leaf's values at index, null for -1."""
    return leaf.values.take(pa.array(np.where(index < 0, 0, index), mask=index < 0)) if len(leaf.values) else pa.nulls(len(index), leaf.values.type)


# ---- search responses ----

#: node: (object, key leaf), as paths below the column `search`.
OPENALEX_NODES = {
    "result": ("search.results", "search.results.id"),
    "venue": ("search.results.primary_location.source", "search.results.primary_location.source.display_name"),
    "authorship": ("search.results.authorships", "search.results.authorships.author.id"),
    "institution": ("search.results.authorships.institutions", "search.results.authorships.institutions.ror"),
}
#: What openalex_nodes needs of a response; load(..., paths=NODE_PATHS) reads and shuffles nothing else.
NODE_PATHS = ("response_id", *(key for _, key in OPENALEX_NODES.values()))
POSITIONS = {"result_pos": "search.results", "author_pos": "search.results.authorships", "institution_pos": "search.results.authorships.institutions", "issn_pos": "search.results.primary_location.source.issn"}

NODE_SCHEMA = "connector string, response_id long, node string, result_pos int, author_pos int, institution_pos int, node_key string"


def nodes_of(leaves: dict[tuple[str, ...], Leaf], ids: pa.Array, connector: str, wanted: dict[str, tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    for node, (obj, key) in wanted.items():
        leaf = leaves[tuple(key.split("."))]
        t = table_at(leaf, tuple(obj.split(".")))
        n = len(t["record"])
        key_text = pc.fill_null(column(leaf, t["value"]).cast(pa.string()), "")
        none = pa.array(np.full(n, -1, np.int32))
        pos = {name: pa.array(t[path]) if path in t else none for name, path in POSITIONS.items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([connector] * n, pa.string()), ids.take(pa.array(t["record"])), pa.array([node] * n, pa.string()), pos["result_pos"], pos["author_pos"], pos["institution_pos"], key_text],
            names=["connector", "response_id", "node", "result_pos", "author_pos", "institution_pos", "node_key"],
        )


def _leaves(column_: pa.Array) -> dict[tuple[str, ...], Leaf]:
    return {x.path: x for x in shred(column_, "search")}


def openalex_nodes(responses: DataFrame) -> DataFrame:
    """One row per non-null result, venue, authorship and institution (NODE_SCHEMA). Responses must be distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from nodes_of(_leaves(b.column("search")), b.column("response_id"), "openalex", OPENALEX_NODES)

    return responses.select("response_id", "search").mapInArrow(run, NODE_SCHEMA)


#: Fields of a Europe PMC result, as text.
EPMC_FIELDS = (
    "id", "source", "pmid", "pmcid", "doi", "title", "authorString", "journalTitle", "journalIssn", "pubYear", "firstPublicationDate", "citedByCount", "isOpenAccess", "inEPMC", "inPMC",
)
EPMC_TYPE = pa.struct([("results", pa.list_(pa.struct([(f, pa.string()) for f in EPMC_FIELDS])))])


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list, bool)) else str(v)


def parse_epmc(texts: pa.Array) -> pa.Array:
    """Response texts to the nested column EPMC_TYPE. A lone object is a list of one; a text that is not complete JSON, or
    in which resultList or result is neither object nor list, is null; an element that is no object is a null element."""
    out = []
    for text in texts.to_pylist():
        try:
            doc = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            doc = None
        held = doc.get("resultList") if isinstance(doc, dict) else None
        found = held.get("result") if isinstance(held, dict) else None
        found = [found] if isinstance(found, dict) else found
        out.append({"results": [{f: _text(x.get(f)) for f in EPMC_FIELDS} if isinstance(x, dict) else None for x in found]} if isinstance(found, list) else None)
    return pa.array(out, EPMC_TYPE)


def epmc_nodes(responses: DataFrame) -> DataFrame:
    """As openalex_nodes, of responses whose column `search` is JSON text; results only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from nodes_of(_leaves(parse_epmc(b.column("search"))), b.column("response_id"), "europe_pmc", {"result": OPENALEX_NODES["result"]})

    return responses.select("response_id", "search").mapInArrow(run, NODE_SCHEMA)


def epmc_works(responses: DataFrame) -> DataFrame:
    """The flat table of Europe PMC results: response_id, result_pos and all fields as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _flat(_leaves(parse_epmc(b.column("search"))), b.column("response_id"), "search.results", {f: f"search.results.{f}" for f in EPMC_FIELDS}, ("result_pos",))

    return responses.select("response_id", "search").mapInArrow(run, "response_id long, result_pos int, " + ", ".join(f"{f} string" for f in EPMC_FIELDS))


def _flat(leaves, ids, obj, columns, positions) -> pa.RecordBatch:
    node = tuple(obj.split("."))
    t, cols = None, []
    for path in columns.values():
        leaf = leaves[tuple(path.split("."))]
        t = table_at(leaf, node)
        cols.append(column(leaf, t["value"]))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(t["record"])), *(pa.array(t[POSITIONS[p]]) for p in positions), *cols], names=["response_id", *positions, *columns])


#: Flat tables of OpenAlex objects: object, position columns (the last is its own, those before link to its parent), fields with their types.
OPENALEX_TABLES = {
    "works": ("search.results", ("result_pos",), {
        "id": "string", "doi": "string", "display_name": "string", "publication_date": "string", "type": "string", "language": "string", "cited_by_count": "long", "is_retracted": "boolean",
        "referenced_works_count": "long", "relevance_score": "double", "primary_location.license": "string", "ids.pmid": "string", "ids.pmcid": "string", "open_access.is_oa": "boolean", "open_access.oa_status": "string",
    }),
    "venues": ("search.results.primary_location.source", ("result_pos",), {"display_name": "string", "issn_l": "string"}),
    "venue_issns": ("search.results.primary_location.source.issn", ("result_pos", "issn_pos"), {"issn": "string"}),
    "authorships": ("search.results.authorships", ("result_pos", "author_pos"), {"author.id": "string", "author.display_name": "string", "author.orcid": "string"}),
    "institutions": ("search.results.authorships.institutions", ("result_pos", "author_pos", "institution_pos"), {"ror": "string"}),
}


def table_paths(table: str) -> tuple[str, ...]:
    """What a flat table needs of a response."""
    obj, _, fields = OPENALEX_TABLES[table]
    return ("response_id", *(obj if obj.endswith(f".{f}") else f"{obj}.{f}" for f in fields))


def openalex_table(responses: DataFrame, table: str) -> DataFrame:
    """One flat table of OPENALEX_TABLES; dots of nested fields become underscores. A list of plain values is an object of one field, named as the list."""
    obj, positions, fields = OPENALEX_TABLES[table]
    columns = {f.replace(".", "_"): obj if obj.endswith(f".{f}") else f"{obj}.{f}" for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _flat(_leaves(b.column("search")), b.column("response_id"), obj, columns, positions)

    schema = ", ".join(["response_id long", *(f"{p} int" for p in positions), *(f"{f.replace('.', '_')} {t}" for f, t in fields.items())])
    return responses.select("response_id", "search").mapInArrow(run, schema)


#: Fields of search.meta of an OpenAlex response.
META = ("count", "next_cursor", "cost_usd")


def responses_table(responses: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """The flat table of the responses themselves, as first delivered: response_id, query_text, fetched_at, ingested_at and fields of search.meta."""
    from pyspark.sql import functions as F

    own = F.struct("query_text", "fetched_at", "ingested_at", *(F.col(f"search.meta.{f}").alias(f"meta_{f}") for f in meta))
    rows = responses.filter("response_id is not null").select("response_id", own.alias("own"))
    # a null time is the last, else a row with one could be lost
    return rows.groupBy("response_id").agg(F.min_by("own", F.struct(F.col("own.ingested_at").isNull(), "own.ingested_at")).alias("own")).select("response_id", "own.*")


def distinct_responses(responses: DataFrame) -> DataFrame:
    """A response delivered twice counts once; rows without a response_id have no key and are no records."""
    return responses.select("response_id", "search").filter("response_id is not null").dropDuplicates(["response_id"])
