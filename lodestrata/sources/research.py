"""Running a discovery plan over recorded pages and recorded acquisitions: runs, attempts, constraints and coverage as tables.

Nothing is fetched: pages, contents and model outputs come as tables, so that a run over the same tables gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ids import content_id_column

c = F.col


def drained(pages: DataFrame, candidates: DataFrame, result_limit: int, page_limit: int, stop_after_empty_pages: int) -> tuple[DataFrame, DataFrame]:
    """(hits, runs) of recorded pages, per connector_id.

    pages: connector_id, page (number in order from 0), next_cursor, n_rejected, n_errors, cost_micro; candidates:
    connector_id, page, position, upstream_id, locator and more. Pages are read in order until so many in a row were empty, the page or
    the result limit is reached, or there are no more; a candidate counts once by (upstream_id, locator), at its first place.
    hits: candidates with hit_rank from 1. runs: counts, termination_reason and truncated of each connector.
    Pages are at most page_limit of a connector, so windows over them are bounded.
    """
    own = Window.partitionBy("connector_id").orderBy("page")
    sizes = candidates.groupBy("connector_id", "page").agg(F.count("*").alias("n"))
    p = pages.filter(c("page") < page_limit).join(sizes, ["connector_id", "page"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # pages in a row without candidates: the distance to the last page that had some
    full = F.max(F.when(c("n") > 0, c("page"))).over(own)
    p = p.withColumn("empty_run", c("page") - F.coalesce(full, F.lit(-1)))
    stop = F.min(F.when(c("empty_run") >= stop_after_empty_pages, c("page"))).over(Window.partitionBy("connector_id"))
    p = p.withColumn("stop", stop).filter(c("stop").isNull() | (c("page") <= c("stop")))
    read = candidates.join(p.select("connector_id", "page"), ["connector_id", "page"], "left_semi")
    first = read.groupBy("connector_id", "upstream_id", "locator").agg(F.min_by(F.struct(*read.columns), F.struct("page", "position")).alias("r")).select("r.*")
    hits = first.withColumn("hit_rank", F.row_number().over(Window.partitionBy("connector_id").orderBy("page", "position"))).filter(c("hit_rank") <= result_limit)
    # the page on which the result limit was reached is the last that was read
    end = hits.groupBy("connector_id").agg(F.max("hit_rank").alias("n_results"), F.max(F.when(c("hit_rank") == result_limit, c("page"))).alias("end"))
    p = p.join(end, "connector_id", "left").filter(c("end").isNull() | (c("page") <= c("end")))
    last = F.max_by("next_cursor", "page")
    seen = read.join(end, "connector_id", "left").join(hits.select("connector_id", "upstream_id", "locator", c("page").alias("first_page"), c("position").alias("first_position")), ["connector_id", "upstream_id", "locator"], "left")
    again = seen.filter((c("end").isNull() | (c("page") <= c("end"))) & c("first_page").isNotNull() & ((c("page") != c("first_page")) | (c("position") != c("first_position"))))
    # after the last result of the last page nothing is read any more
    final = hits.filter(c("hit_rank") == result_limit).select("connector_id", c("page").alias("fp"), c("position").alias("fq"))
    again = again.join(final, "connector_id", "left").filter(c("fp").isNull() | (F.struct("page", "position") < F.struct(c("fp").alias("page"), c("fq").alias("position"))))
    repeats = again.groupBy("connector_id").agg(F.count("*").alias("n_duplicates"))
    runs = p.groupBy("connector_id").agg(
        F.count("*").alias("n_pages"), F.max("n_results").alias("n_results"), F.sum("n_rejected").alias("n_rejected"), F.sum("n_errors").alias("n_errors"), F.sum("cost_micro").alias("cost_micro"),
        F.max("stop").alias("stop"), F.max("end").alias("end"), last.alias("next"), F.max("page").alias("last_page"),
    )
    reason = F.when(c("end").isNotNull(), "result_limit").when(c("stop").isNotNull() & (c("stop") == c("last_page")), "empty_page_limit").when(c("n_pages") >= page_limit, "page_limit").otherwise("connector_exhausted")
    runs = runs.join(repeats, "connector_id", "left").withColumn("termination_reason", reason)
    zero = lambda x: F.coalesce(c(x), F.lit(0)).alias(x)
    truncated = c("termination_reason").isin("result_limit", "page_limit") & c("next").isNotNull()
    return hits, runs.select("connector_id", "n_pages", zero("n_results"), zero("n_duplicates"), zero("n_rejected"), zero("n_errors"), zero("cost_micro"), "termination_reason", truncated.alias("truncated"))


#: Reasons for which a hit is not acquired, by words of the error that says so; else it is not found.
REASONS = (("size_limit", ("size", "limit")), ("unsupported_media_type", ("media type",)), ("policy", ("escape", "scheme")))


def reason(error: Column) -> Column:
    """The reason that an error's text names."""
    out = F.lit("not_found")
    for name, words in reversed(REASONS):
        some = F.lit(False)
        for w in words:
            some = some | F.contains(F.lower(error), F.lit(w))
        out = F.when(some, name).otherwise(out)
    return out


def attempts(hits: DataFrame, acquired: DataFrame) -> DataFrame:
    """One attempt per hit (hit_id, locator): acquired has hit_id, content_sha256, error; outcome is success or the reason. A hit that nothing was recorded for was not attempted."""
    both = hits.select("hit_id", "locator").join(acquired, "hit_id")
    ok = c("content_sha256").isNotNull()
    outcome = F.when(ok, "success").otherwise(reason(F.coalesce("error", F.lit(""))))
    state = F.when(ok, "content_acquired").otherwise("discovered")
    return both.select(content_id_column("acquisition-attempt", hit_id=c("hit_id"), outcome=outcome).alias("id"), "hit_id", "locator", outcome.alias("outcome"), state.alias("state"), "content_sha256", c("error").alias("detail"))


def constraints(attempted: DataFrame) -> DataFrame:
    """target_id, locator, reason, detail of every attempt that failed."""
    return attempted.filter("outcome <> 'success'").select(c("hit_id").alias("target_id"), "locator", c("outcome").alias("reason"), "detail")


def coverage(hits: DataFrame, attempted: DataFrame, plan_id: str, least_sources: int) -> DataFrame:
    """One row: discovered, accessible (distinct contents), inaccessible, metadata_only and the ids of the gaps that are left: no results, too few sources."""
    found = hits.agg(F.count("*").alias("discovered"))
    got = attempted.agg(F.count_if(c("outcome") == "success").alias("accessible"), F.count_if(c("outcome") != "success").alias("inaccessible"))
    one = found.withColumn("_one", F.lit(1)).join(got.withColumn("_one", F.lit(1)), "_one").drop("_one")
    none = content_id_column("knowledge-gap", plan=F.lit(plan_id), reason=F.lit("no_results"))
    few = content_id_column("knowledge-gap", plan=F.lit(plan_id), reason=F.lit("independent_source_minimum"), required=F.lit(least_sources), accessible=c("accessible").cast("int"))
    gaps = F.array_compact(F.array(F.when(c("discovered") == 0, none), F.when(c("accessible") < least_sources, few)))
    return one.select(F.lit(plan_id).alias("plan_id"), "*", F.greatest(F.lit(0), c("discovered") - c("accessible") - c("inaccessible")).alias("metadata_only"), gaps.alias("gap_ids"))


def run(pages: DataFrame, candidates: DataFrame, acquired: DataFrame, plan_id: str, result_limit: int, page_limit: int, stop_after_empty_pages: int = 2, least_sources: int = 1) -> dict[str, DataFrame]:
    """The tables of an offline run: hits (with hit_id), runs, attempts, constraints, coverage."""
    hits, runs = drained(pages, candidates, result_limit, page_limit, stop_after_empty_pages)
    hits = hits.withColumn("hit_id", content_id_column("discovery-hit", plan=F.lit(plan_id), connector=c("connector_id"), upstream=c("upstream_id"), locator=c("locator")))
    tried = attempts(hits, acquired)
    return {"hits": hits, "runs": runs, "attempts": tried, "constraints": constraints(tried), "coverage": coverage(hits, tried, plan_id, least_sources)}


def deposited(files: DataFrame, overrides: DataFrame, defaults: dict[str, str | None]) -> DataFrame:
    """Files (source_version_id and more) with the provenance fields of `defaults`, each overridden by the file's own where it gives one, and <field>_status: declared or unknown."""
    given = overrides.select("source_version_id", *(c(f).alias(f"_{f}") for f in defaults))
    both = files.join(given, "source_version_id", "left")
    out = both.withColumns({f: F.coalesce(c(f"_{f}"), F.lit(v).cast("string")) for f, v in defaults.items()}).drop(*(f"_{f}" for f in defaults))
    return out.withColumns({f"{f}_status": F.when(F.coalesce(c(f), F.lit("")) != "", "declared").otherwise("unknown") for f in defaults})


def appended(rows: DataFrame, path: str) -> None:
    """Appends rows to an audit log of JSON lines."""
    rows.write.mode("append").json(path)


def replayed(requests: DataFrame, outputs: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of recorded model outputs (request_id, body: JSON text) for requests (request_id and more).

    items: the request with `item`, one row per element of the output's list `items`, typed by `schema`; failures: request_id, stage (no_output, output_validation) and detail.
    """
    both = requests.join(outputs.groupBy("request_id").agg(F.max("body").alias("body")), "request_id", "left")
    parsed = both.withColumn("_p", F.from_json("body", f"items array<{schema}>"))
    ok = c("_p")["items"].isNotNull()
    items = parsed.filter(ok).select(*requests.columns, F.explode(c("_p")["items"]).alias("item"))
    failed = parsed.filter(~F.coalesce(ok, F.lit(False)))
    stage = F.when(c("body").isNull(), "no_output").otherwise("output_validation")
    return items, failed.select("request_id", stage.alias("stage"), F.substring("body", 1, 200).alias("detail"))
