"""The named queries of the core: name -> (spark, directory) -> DataFrame, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import hierarchy as H
from lodestrata.operators import references as R
from lodestrata.operators import shredding as S
from lodestrata.registry import QUERIES, SQL, query
from lodestrata.registry import sql_id as _id
from lodestrata.session import load

#: Runs as the smoke check.
FLAGSHIP = "fts_bm25_topk"


# ---- 1: nested records ----


@query(
    """
with oa as (select response_id, any_value(search) s from openalex_search where response_id is not null group by response_id),
r as (select response_id, s.results[p] w, p - 1 result_pos from oa, unnest(range(1, len(s.results) + 1)) t(p)),
a as (select response_id, result_pos, w.authorships[p] au, p - 1 author_pos from r, unnest(range(1, len(w.authorships) + 1)) t(p)),
i as (select response_id, result_pos, author_pos, au.institutions[p] inst, p - 1 institution_pos from a, unnest(range(1, len(au.institutions) + 1)) t(p)),
em as (select response_id, any_value(search) s from europe_pmc_search where response_id is not null group by response_id),
ej as (select response_id, s::json -> '$.resultList.result' j from em where json_valid(s)),
el as (select response_id, case json_type(j) when 'ARRAY' then json_extract(j, '$[*]') when 'OBJECT' then [j] end l from ej),
er as (select response_id, l[p] w, p - 1 result_pos from el, unnest(range(1, len(l) + 1)) t(p))
select 'openalex' connector, response_id, 'result' node, result_pos::int result_pos, -1::int author_pos, -1::int institution_pos, coalesce(w.id, '') node_key from r where w is not null
union all select 'openalex', response_id, 'venue', result_pos::int, -1, -1, coalesce(w.primary_location.source.display_name, '') from r where w.primary_location.source is not null
union all select 'openalex', response_id, 'authorship', result_pos::int, author_pos::int, -1, coalesce(au.author.id, '') from a where au is not null
union all select 'openalex', response_id, 'institution', result_pos::int, author_pos::int, institution_pos::int, coalesce(inst.ror, '') from i where inst is not null
union all select 'europe_pmc', response_id, 'result', result_pos::int, -1, -1, coalesce(w ->> '$.id', '') from er where json_type(w) = 'OBJECT'
"""
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null object of both search tables, linked by response and positions."""
    return S.openalex_nodes(S.distinct_responses(load(spark, d, "openalex_search", S.NODE_PATHS))).unionByName(S.epmc_nodes(S.distinct_responses(load(spark, d, "europe_pmc_search"))))


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: S.openalex_table(S.distinct_responses(load(spark, d, "openalex_search", S.table_paths(name))), name)


for _name in S.OPENALEX_TABLES:
    QUERIES[f"p1_{_name}"] = _table(_name)

SQL["p1_institutions"] = """
with oa as (select response_id, any_value(search) s from openalex_search where response_id is not null group by response_id),
r as (select response_id, s.results[p] w, p - 1 result_pos from oa, unnest(range(1, len(s.results) + 1)) t(p)),
a as (select response_id, result_pos, w.authorships[p] au, p - 1 author_pos from r, unnest(range(1, len(w.authorships) + 1)) t(p)),
i as (select response_id, result_pos, author_pos, au.institutions[p] inst, p - 1 institution_pos from a, unnest(range(1, len(au.institutions) + 1)) t(p))
select response_id, result_pos::int result_pos, author_pos::int author_pos, institution_pos::int institution_pos, inst.ror ror from i where inst is not null
"""
SQL["p1_venues"] = """
with oa as (select response_id, any_value(search) s from openalex_search where response_id is not null group by response_id),
r as (select response_id, s.results[p] w, p - 1 result_pos from oa, unnest(range(1, len(s.results) + 1)) t(p))
select response_id, result_pos::int result_pos, w.primary_location.source.display_name display_name, w.primary_location.source.issn_l issn_l from r where w.primary_location.source is not null
"""
SQL["p1_venue_issns"] = """
with oa as (select response_id, any_value(search) s from openalex_search where response_id is not null group by response_id),
r as (select response_id, s.results[p] w, p - 1 result_pos from oa, unnest(range(1, len(s.results) + 1)) t(p)),
i as (select response_id, result_pos, w.primary_location.source.issn[p] issn, p - 1 issn_pos from r, unnest(range(1, len(w.primary_location.source.issn) + 1)) t(p))
select response_id, result_pos::int result_pos, issn_pos::int issn_pos, issn from i where issn is not null
"""
SQL["p1_authorships"] = """
with oa as (select response_id, any_value(search) s from openalex_search where response_id is not null group by response_id),
r as (select response_id, s.results[p] w, p - 1 result_pos from oa, unnest(range(1, len(s.results) + 1)) t(p)),
a as (select response_id, result_pos, w.authorships[p] au, p - 1 author_pos from r, unnest(range(1, len(w.authorships) + 1)) t(p))
select response_id, result_pos::int result_pos, author_pos::int author_pos, au.author.id author_id, au.author.display_name author_display_name, au.author.orcid author_orcid from a where au is not null
"""
SQL["p1_works"] = """
with oa as (select response_id, any_value(search) s from openalex_search where response_id is not null group by response_id),
r as (select response_id, s.results[p] w, p - 1 result_pos from oa, unnest(range(1, len(s.results) + 1)) t(p))
select response_id, result_pos::int result_pos, w.id id, w.doi doi, w.display_name display_name, w.publication_date publication_date, w.type "type", w.language "language", w.cited_by_count cited_by_count,
w.is_retracted is_retracted, w.referenced_works_count referenced_works_count, w.relevance_score relevance_score, w.primary_location.license primary_location_license, w.ids.pmid ids_pmid, w.ids.pmcid ids_pmcid,
w.open_access.is_oa open_access_is_oa, w.open_access.oa_status open_access_oa_status from r where w is not null
"""


@query(
    """select response_id, query_text, fetched_at, ingested_at, search.meta.count meta_count, search.meta.next_cursor meta_next_cursor, search.meta.cost_usd meta_cost_usd
from openalex_search where response_id is not null qualify row_number() over (partition by response_id order by ingested_at nulls last) = 1"""
)
def p1_responses(spark: SparkSession, d: str) -> DataFrame:
    """The responses of OpenAlex that the other tables link to."""
    return S.responses_table(load(spark, d, "openalex_search"), S.META)


@query("select response_id, query_text, fetched_at, ingested_at from europe_pmc_search where response_id is not null qualify row_number() over (partition by response_id order by ingested_at nulls last) = 1")
def p1_epmc_responses(spark: SparkSession, d: str) -> DataFrame:
    """The responses of Europe PMC that its works link to."""
    return S.responses_table(load(spark, d, "europe_pmc_search"))


@query(
    f"""with em as (select response_id, any_value(search) s from europe_pmc_search where response_id is not null group by response_id), ej as (select response_id, s::json -> '$.resultList.result' j from em where json_valid(s)),
el as (select response_id, case json_type(j) when 'ARRAY' then json_extract(j, '$[*]') when 'OBJECT' then [j] end l from ej), er as (select response_id, l[p] w, p - 1 result_pos from el, unnest(range(1, len(l) + 1)) t(p))
select response_id, result_pos::int result_pos, {", ".join(f"w ->> '$.{x}' {x}" for x in S.EPMC_FIELDS).replace(" source,", ' "source",')} from er where json_type(w) = 'OBJECT'"""
)
def p1_epmc_works(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of Europe PMC results."""
    return S.epmc_works(S.distinct_responses(load(spark, d, "europe_pmc_search")))


# ---- 2: references ----


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    anchors, links = load(spark, d, "library_anchor"), load(spark, d, "concept_parent")
    one = lambda c: F.array(R.norm_id(c))
    refs = R.references(anchors, "library_anchor", "anchor_id", {"source_version_id": one("source_version_id"), "threat_observation_ids": R.id_list("threat_observation_ids")})
    refs = refs.unionByName(R.references(links, "concept_parent", "concept_id", {"parent_id": one("parent_id")}))
    parents = R.targets(load(spark, d, "library_source"), "source_version_id", "source_version_id").unionByName(R.targets(load(spark, d, "threat_observation"), "id", "threat_observation_ids"))
    return R.orphans(refs, parents.unionByName(R.targets(load(spark, d, "concept"), "id", "parent_id")))


_REFS = f"""
refs as (
select 'library_anchor' table_name, 'source_version_id' field_name, {_id("anchor_id")} record_key, {_id("source_version_id")} ref_key, ingested_at, recorded_at from library_anchor
union all select 'library_anchor', 'threat_observation_ids', {_id("anchor_id")}, {_id("x")}, ingested_at, recorded_at
  from library_anchor, unnest(string_split(regexp_replace(coalesce(threat_observation_ids, ''), '[\\[\\]"]', '', 'g'), ',')) t(x)
union all select 'concept_parent', 'parent_id', {_id("concept_id")}, {_id("parent_id")}, ingested_at, recorded_at from concept_parent),
r as (select table_name, field_name, record_key, ref_key, min(ingested_at) ingested_at, min(recorded_at) recorded_at from refs where record_key is not null and ref_key is not null group by all),
tg as (
select 'source_version_id' field_name, {_id("source_version_id")} ref_key, min(ingested_at) since, min(retired_at) until from library_source group by all
union all select 'threat_observation_ids', {_id("id")}, min(ingested_at), min(retired_at) from threat_observation group by all
union all select 'parent_id', {_id("id")}, min(ingested_at), min(retired_at) from concept group by all),
o as (select r.*, case when tg.ref_key is null then 'missing' when since > ingested_at then 'late' when until <= ingested_at then 'deleted' end reason
from r left join tg using (field_name, ref_key))
"""


@query(f"with {_REFS} select table_name, field_name, record_key, ref_key, reason from o where reason is not null")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference to a target that is missing, late or deleted."""
    return _orphans(spark, d).select("table_name", "field_name", "record_key", "ref_key", "reason")


@query(
    f"with {_REFS} select table_name, field_name, strftime(recorded_at, '%Y-%m') as month, reason, count(*) n_references, count(distinct record_key) n_records "
    "from o where reason is not null group by all"
)
def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field and month."""
    return R.report(_orphans(spark, d))


# ---- 6: hierarchies ----

_TREE = f"""
with recursive e as (select {_id("concept_id")} c, min({_id("parent_id")}) p from concept_parent where {_id("concept_id")} is not null group by 1),
ids as (select c id from e union select p from e where p is not null),
up as (select id, id node, 0 k from ids union all select up.id, e.p, k + 1 from up join e on e.c = up.node where e.p is not null and k < 1000),
top as (select up.id, up.node root_id, up.k depth from up left join e on e.c = up.node where e.p is null)
"""


@query(_TREE + "select ids.id concept_id, coalesce(root_id, '') root_id, coalesce(depth, -1)::int depth from ids left join top using (id)")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every concept; an empty root and -1 where the links lead into a cycle."""
    t = H.hierarchy(load(spark, d, "concept_parent"), paths=False)
    return t.select(F.col("node").alias("concept_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


@query(
    _TREE + """, loop as (select distinct id from up where id = node and k > 0), below as (select node, count(*) n, max(k) h from up where node not in (select id from loop) group by 1),
way as (select up.id, string_agg(up.node, ' > ' order by up.k desc) path from up where up.id in (select id from top) group by 1)
select ids.id concept_id, coalesce(root_id, '') root_id, coalesce(depth, -1)::int depth, h::int height, n subtree_size, path from ids left join top using (id) left join below on below.node = ids.id left join way using (id)"""
)
def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, height and subtree size of every concept."""
    t = H.hierarchy(load(spark, d, "concept_parent"))
    return t.select(F.col("node").alias("concept_id"), F.col("root").alias("root_id"), "depth", "height", F.col("size").alias("subtree_size"), F.array_join("path", " > ").alias("path"))


@query(_TREE + "select up.node ancestor_id, up.id descendant_id, up.k::int distance from up join top on top.id = up.id where up.k > 0")
def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every ancestor-descendant pair with its distance."""
    t = H.descendants(load(spark, d, "concept_parent"))
    return t.select(F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("int").alias("distance"))


from lodestrata import engine_queries  # noqa: E402, F401  (registers the queries of the engine's own operators)
