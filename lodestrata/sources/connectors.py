"""Recorded search responses of public APIs to one table of discovery candidates, and a DataSource over recorded pages.

Fetching is the caller's: an API's pages are read as files or tables. Every mapping gives HIT columns; records whose own
identifier is bad are rejected (left out of the hits), optional identifiers that are bad are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import identifiers as I
from lodestrata.functions.text import is_public_url, plain_html

HIT = ("connector_id", "upstream_id", "rank", "title", "authors", "publisher", "locator", "published_at", "language", "score", "known_ids", "snippet")

CROSSREF = (
    "status string, message struct<`next-cursor`:string, items:array<struct<DOI:string, title:array<string>, author:array<struct<given:string, family:string, name:string>>, publisher:string, "
    "published:struct<`date-parts`:array<array<int>>>, language:string, score:double>>>"
)
MOJEEK = "response struct<status:string, head:struct<results:long>, results:array<struct<url:string, title:string, `desc`:string>>>"
UNPAYWALL = (
    "doi string, title string, genre string, is_paratext boolean, is_oa boolean, oa_status string, oa_locations array<struct<url:string, url_for_landing_page:string, url_for_pdf:string, host_type:string, "
    "version:string, license:string, evidence:string, repository_institution:string, is_best:boolean>>"
)


def _known(**ids: Column) -> Column:
    return F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), v)) for k, v in ids.items())))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.coalesce(month, F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(day, F.lit(1)).cast("string"), 2, "0")), "yyyy-MM-dd")


def date_of(text: Column) -> Column:
    """A date of an ISO date or a bare year, null if it is neither."""
    return F.when(text.rlike(r"^[0-9]{4}$"), F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd")).when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def openalex_hits(works: DataFrame) -> DataFrame:
    """Hits of shredded OpenAlex works (response_id, result_pos and fields). The work's own id must be W and digits."""
    own = F.regexp_extract("id", r"(?:^|/)(W[0-9]+)$", 1)
    doi = I.doi("doi")
    return (
        works.filter(own != "")
        .select(
            F.lit("openalex").alias("connector_id"), own.alias("upstream_id"), "response_id", F.col("result_pos").alias("rank"), F.col("display_name").alias("title"),
            F.coalesce(I.doi_locator("doi"), F.col("id")).alias("locator"), date_of(F.col("publication_date")).alias("published_at"), "language", F.col("relevance_score").alias("score"),
            _known(doi=doi, pmid=I.pmid("ids_pmid"), pmcid=I.pmcid("ids_pmcid")).alias("known_ids"),
        )
    )


def europe_pmc_hits(works: DataFrame) -> DataFrame:
    """Hits of shredded Europe PMC works. The record's own source and id must be there; the score falls with the rank."""
    return works.filter("id rlike '^[A-Za-z0-9]+$' and source rlike '^[A-Z]{3}$'").select(
        F.lit("europe_pmc").alias("connector_id"), F.concat_ws(":", "source", "id").alias("upstream_id"), "response_id", F.col("result_pos").alias("rank"), "title",
        F.coalesce(I.doi_locator("doi"), F.concat(F.lit("https://europepmc.org/article/"), "source", F.lit("/"), "id")).alias("locator"),
        F.coalesce(date_of(F.col("firstPublicationDate")), date_of(F.col("pubYear"))).alias("published_at"), F.lit(None).cast("string").alias("language"),
        F.greatest(F.lit(0.0), F.lit(100.0) - F.col("result_pos")).alias("score"), _known(doi=I.doi("doi"), pmid=I.pmid("pmid"), pmcid=I.pmcid("pmcid"), issn=I.issn("journalIssn")).alias("known_ids"),
    )


def crossref_hits(responses: DataFrame) -> DataFrame:
    """Hits of Crossref responses (response_id, body: JSON text). A bad DOI rejects the record."""
    items = responses.select("response_id", F.posexplode(F.from_json("body", CROSSREF)["message"]["items"]).alias("rank", "w"))
    parts = F.element_at(F.col("w.published")["date-parts"], 1)
    at = lambda k: F.try_element_at(parts, F.lit(k))
    person = lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"]))
    return items.withColumn("doi", I.doi(F.col("w.DOI"))).filter("doi is not null").select(
        F.lit("crossref").alias("connector_id"), F.col("doi").alias("upstream_id"), "response_id", "rank", plain_html(F.try_element_at(F.col("w.title"), F.lit(1))).alias("title"),
        F.transform("w.author", person).alias("authors"), F.col("w.publisher").alias("publisher"), I.doi_locator("doi").alias("locator"), _date(at(1), at(2), at(3)).alias("published_at"), F.col("w.language").alias("language"),
        F.col("w.score").alias("score"), _known(doi=F.col("doi")).alias("known_ids"),
    )


def mojeek_hits(responses: DataFrame) -> DataFrame:
    """Hits of Mojeek responses (response_id, body). Addresses that are not public are rejected."""
    items = responses.select("response_id", F.posexplode(F.from_json("body", MOJEEK)["response"]["results"]).alias("rank", "w"))
    return items.filter(is_public_url("w.url")).select(
        F.lit("mojeek").alias("connector_id"), F.sha2("w.url", 256).alias("upstream_id"), "response_id", "rank", plain_html("w.title").alias("title"), F.col("w.url").alias("locator"), plain_html("w.desc").alias("snippet")
    )


def unpaywall_locations(responses: DataFrame) -> DataFrame:
    """doi, ordinal and fields of each distinct public location of Unpaywall answers (body); best, repositories, with a file first."""
    r = responses.select(F.from_json("body", UNPAYWALL).alias("r")).withColumn("doi", I.doi("r.doi")).filter("doi is not null")
    loc = r.select("doi", F.explode("r.oa_locations").alias("l")).select("doi", "l.*").filter(is_public_url("url")).dropDuplicates(["doi", "url", "url_for_landing_page", "url_for_pdf"])
    from pyspark.sql import Window

    order = Window.partitionBy("doi").orderBy(F.desc("is_best"), F.desc(F.col("host_type") == "repository"), F.desc(F.col("url_for_pdf").isNotNull()), "url", "url_for_pdf", "url_for_landing_page")
    return loc.withColumn("ordinal", F.row_number().over(order) - 1)


def executed(hits: DataFrame, limit: int) -> DataFrame:
    """The first `limit` distinct hits (upstream_id, locator) of each connector, in order of response and rank, ranked from 1."""
    from pyspark.sql import Window

    once = hits.groupBy("connector_id", "upstream_id", "locator").agg(F.min(F.struct("response_id", "rank")).alias("at"))
    w = Window.partitionBy("connector_id").orderBy("at", "upstream_id", "locator")
    return once.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= limit)  # Spark keeps the best of each group only, before the shuffle


def register_pages(spark: SparkSession) -> None:
    """Registers the DataSource `recorded_pages`: option `folder` with one JSON page per file; each page is a partition."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.folder = options["folder"]

        def partitions(self):
            import os

            return [InputPartition(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")]

        def read(self, partition):
            with open(partition.value, encoding="utf-8") as f:
                yield (partition.value.rsplit("/", 1)[-1], f.read())

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "recorded_pages"

        def schema(self):
            return "page string, body string"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Pages)
