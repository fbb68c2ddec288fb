"""The registered queries of the picture operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as texts
from ..operators import context, dedupe, evaluation, ingest, privacy, sampling, summary, vectors
from ..operators import rules as R
from ..operators.scratch import place
from ..operators.verdict import judge, judge_again, judge_uploads
from ..sources import files
from .pictures import GAPPY_SQL, HARD_SQL, METADATA_SQL, NOT_SHARP_SQL, PICTURES_SQL, RULES, gappy, pictures, table, verdict_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _verdict(judged: DataFrame) -> DataFrame:
    return judged.select("id", "collection", "rank", "excluded", F.array_join("issues", ",").alias("issues"), "low_quality", F.col("context.neighbours").cast("long").alias("neighbours"), F.col("context.topiq_median").alias("median"), F.col("context.blurred_median").alias("area_median"))


VERDICT_ROWS = """select id, collection, rank, excluded, issues, excluded is not null as low_quality, case when n >= 2 then n end as neighbours,
  case when n >= 2 and reason is null then med end as median, case when n >= 2 and reason is null then area_med end as area_median from judged"""


@query(verdict_sql() + VERDICT_ROWS)
def verdict_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _verdict(judge(pictures(spark, d), RULES))


@query(verdict_sql("ranked", f", {GAPPY_SQL}") + VERDICT_ROWS)
def verdict_gaps_ties(spark: SparkSession, d: str) -> DataFrame:
    return _verdict(judge(gappy(pictures(spark, d)), RULES))


@query(f"""with {PICTURES_SQL}, r as (select *, {HARD_SQL} as reason from pictures),
f as (select *, reason is null and coalesce(quality_score < case when is_pano then 0.32 else 0.40 end, false) as low from r)
select id, coalesce(reason, case when low then 'low_quality' end) as excluded, case when low then 'low_quality' else '' end as issues from f""")
def verdict_alone(spark: SparkSession, d: str) -> DataFrame:
    judged = judge(pictures(spark, d).drop("collection", "rank"), RULES)
    return judged.select("id", "excluded", F.array_join("issues", ",").alias("issues"))


NEAR_SQL = """, near as (select id, count(*) over w as neighbours, median(quality_score) over w as median from {source}
window w as (partition by collection order by rank range between 10 preceding and 10 following exclude current row))
select id, neighbours, median from near"""


def _near(df: DataFrame) -> DataFrame:
    near = context.neighbourhood(df, 10, ("quality_score",))
    return near.select("id", F.size("__near").cast("long").alias("neighbours"), context.near_median("quality_score").alias("median"))


@query(f"with {PICTURES_SQL}" + NEAR_SQL.format(source="pictures"))
def neighbour_median(spark: SparkSession, d: str) -> DataFrame:
    return _near(pictures(spark, d))


@query(f"with {PICTURES_SQL}, {GAPPY_SQL}" + NEAR_SQL.format(source="ranked"))
def neighbour_gaps_ties(spark: SparkSession, d: str) -> DataFrame:
    return _near(gappy(pictures(spark, d)))


@query(f"""with {PICTURES_SQL}, near as (select *, count(waviness_label) over w as measured, count(*) filter (waviness_label = 'wavy') over w as wavy from pictures
window w as (partition by collection order by rank range between 10 preceding and 10 following exclude current row))
select id, coalesce(waviness_label = 'wavy' and measured >= 2 and wavy / measured::double >= 0.3, false) as confirmed from near""")
def confirmed_wavy(spark: SparkSession, d: str) -> DataFrame:
    near = context.neighbourhood(pictures(spark, d), 10, ("waviness_label",))
    return near.select("id", context.confirmed_wavy(0.30).alias("confirmed"))


@query(f"with {PICTURES_SQL} select id, {METADATA_SQL.format(gps=10)} as reason from pictures")
def metadata_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).select("id", R.metadata_reason(R.Rules(max_gps_accuracy=10)).alias("reason"))


@query(f"with {PICTURES_SQL} select id, coalesce(privacy_blur > 0.05, false) as exceeded from pictures")
def privacy_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).select("id", R.privacy_exceeded(0.05).alias("exceeded"))


@query(f"with {PICTURES_SQL} select id, coalesce({NOT_SHARP_SQL}, false) as not_sharp from pictures")
def not_sharp(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).select("id", R.not_sharp(RULES).alias("not_sharp"))


@query(f"with {PICTURES_SQL} select id, coalesce(orientation <> 0 and orientation_confidence >= 0.95, false) as wrong from pictures")
def wrong_orientation(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).withColumn("orientation_views", F.lit(None).cast(R.views_type())).select("id", R.wrong_orientation(0.95).alias("wrong"))


@query(f"with {PICTURES_SQL} select id, {HARD_SQL} as reason from pictures")
def hard_cascade(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).withColumn("orientation_views", F.lit(None).cast(R.views_type())).select("id", R.hard_reason(RULES).alias("reason"))


VIEWS_SQL = f"""with {PICTURES_SQL}, g as (select position // 4 as g, position, orientation, orientation_confidence from pictures),
s as (select g, count(*) filter (orientation <> 0 and orientation_confidence >= 0.8) as turned, count(*) filter (orientation <> 0) as rotated, min(orientation_confidence) as least_confidence,
  list(struct_pack(c := orientation_confidence, r := orientation) order by orientation_confidence desc, orientation desc) filter (orientation <> 0) as l from g group by g)
select g, turned >= 2 as wrong, case when rotated >= 2 then l[2].r else 0 end as rotation, case when rotated >= 2 then l[2].c else least_confidence end as confidence from s"""


@query(VIEWS_SQL)
def orientation_views_rule(spark: SparkSession, d: str) -> DataFrame:
    view = F.struct(F.col("orientation").alias("rotation"), F.col("orientation_confidence").alias("confidence"))
    none = {"orientation": F.lit(None).cast("int"), "orientation_confidence": F.lit(None).cast("double")}
    rows = pictures(spark, d).groupBy(F.floor(F.col("position") / 4).alias("g")).agg(F.collect_list(view).alias("orientation_views")).withColumns(none)
    second = vectors.second_best_rotated(F.col("orientation_views"))
    return rows.select("g", R.wrong_orientation(0.8).alias("wrong"), second["rotation"].alias("rotation"), second["confidence"].alias("confidence"))


@query(verdict_sql() + """select id, case when position % 13 = 0 then 'kept_by_hand' else excluded end as excluded, case when position % 13 = 0 then 'kept_by_hand' else issues end as issues from judged""")
def frozen_verdicts(spark: SparkSession, d: str) -> DataFrame:
    held = F.col("position") % 13 == 0
    rows = pictures(spark, d).withColumns({"context_fetched": held, "excluded": F.when(held, "kept_by_hand"), "issues": F.when(held, F.array(F.lit("kept_by_hand"))), "low_quality": held})
    return judge_again(rows, RULES).select("id", "excluded", F.array_join("issues", ",").alias("issues"))


UPLOAD_SQL = verdict_sql("ranked", ", ranked as (select * exclude (rank), cast(row_number() over (partition by collection order by position) as integer) as rank from pictures)")


@query(UPLOAD_SQL + "select id, rank, excluded, case when n >= 2 then n end as neighbours from judged")
def upload_sequence(spark: SparkSession, d: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("collection").orderBy("position")) - 1
    judged = judge_uploads(pictures(spark, d).withColumn("at", order), "at", RULES, "collection")
    return judged.select("id", "rank", "excluded", F.col("context.neighbours").cast("long").alias("neighbours"))


@query(verdict_sql() + """select collection, count(*) as pictures, round(median(quality_score), 4) as median, count(excluded) as excluded,
  first(camera order by position) as camera from judged group by collection""")
def sequence_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.sequence_summary(judge(pictures(spark, d), RULES))


@query(verdict_sql() + "select excluded as value, count(*) as n, min(position) as first_seen from judged where excluded is not null group by excluded")
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return summary.histogram(judge(pictures(spark, d), RULES), "excluded")


@query(f"with {PICTURES_SQL} select camera as value, count(*) as n, min(position) as first_seen from pictures group by camera")
def record_histogram(spark: SparkSession, d: str) -> DataFrame:
    return summary.histogram(pictures(spark, d), "camera")


@query(verdict_sql() + "select count(*) as pictures, count(*) filter (excluded is null) as kept, count(excluded) as excluded, count(*) filter (n >= 2) as in_context from judged")
def verdict_totals(spark: SparkSession, d: str) -> DataFrame:
    return summary.totals(judge(pictures(spark, d), RULES))


def _review(order: str, sql: str, kind: str = "all", where: str = "true", value: str | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return summary.review_rows(judge(pictures(spark, d), RULES), order, kind, value).select("id", F.col("place").cast("long").alias("place"))

    run.__name__ = f"review_{order}" + ("" if kind == "all" else f"_{kind}")
    query(verdict_sql() + f"select id, row_number() over (order by {sql}) as place from judged where {where}")(run)


_review("worst", "excluded is null, coalesce(quality_score, 0), position")
_review("best", "coalesce(quality_score, 0) desc, position")
_review("sequence", "collection nulls first, coalesce(rank, 0), position")
_review("worst", "excluded is null, coalesce(quality_score, 0), position", "excluded", "excluded is not null")
_review("best", "coalesce(quality_score, 0) desc, position", "kept", "excluded is null")
_review("worst", "excluded is null, coalesce(quality_score, 0), position", "reason", "excluded = 'privacy_blur'", "privacy_blur")
_review("sequence", "collection nulls first, coalesce(rank, 0), position", "sequence", "collection = '3'", "3")


@query(verdict_sql() + "select id, collection, rank, camera, excluded, quality_score, 'https://thumbs.example/' || id as thumb from judged")
def card_projection(spark: SparkSession, d: str) -> DataFrame:
    cards = summary.cards(judge(pictures(spark, d), RULES), thumb=F.concat(F.lit("https://thumbs.example/"), F.col("id")))
    return cards.select("id", "collection", "rank", "camera", "excluded", "quality_score", "thumb")


@query(verdict_sql() + """, t as (select id, collection, model, unnest(string_split(issues, ',')) as issue, generate_subscripts(string_split(issues, ','), 1) as k from judged where issues <> '' and instance_api is not null)
select id, collection, cast(2 * (k - 1) as integer) as at, 'street_view_quality' as key, issue as value, 'add' as action from t
union all select id, collection, cast(2 * k - 1 as integer), 'detection_model[street_view_quality=' || issue || ']', model, 'add' from t""")
def tag_payload(spark: SparkSession, d: str) -> DataFrame:
    return summary.tag_payload(judge(pictures(spark, d), RULES))


ITEM_COLUMNS = """cast(event_id as varchar) as id, cast(user_id as varchar) as collection,
  case when event_id % 4 <> 0 then case when event_id % 3 = 0 then 360.0::double else 96.0::double end end as fov,
  case when event_id % 5 = 0 then null when event_id % 5 = 1 then '' else event_type end as maker, case when event_id % 6 <> 0 then 'M' || (event_id % 9) end as cam,
  case when event_id % 7 = 0 then null else 'https://meta' || (event_id % 3) || '.example/' end as via, case when event_id % 11 = 0 then null else 'https://root' || (event_id % 2) || '.example/api/' end as root,
  case when event_id % 8 = 0 then null when event_id % 2 = 0 then '/pic/' || event_id || '.jpg' else 'https://cdn.example/' || event_id || '.jpg' end as href"""


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Nested catalogue items made of events."""
    i = F.col("event_id")
    s = i.cast("string")
    link = lambda rel, href: F.struct(F.lit(rel).alias("rel"), href.alias("href"), F.lit(None).cast("string").alias("instance_name"))
    via = F.when(i % 7 != 0, F.array(link("via", F.concat(F.lit("https://meta"), (i % 3).cast("string"), F.lit(".example/"))))).otherwise(F.array().cast("array<struct<rel:string,href:string,instance_name:string>>"))
    root = F.when(i % 11 != 0, F.array(link("root", F.concat(F.lit("https://root"), (i % 2).cast("string"), F.lit(".example/api/"))))).otherwise(F.array().cast("array<struct<rel:string,href:string,instance_name:string>>"))
    href = F.when(i % 8 == 0, None).when(i % 2 == 0, F.concat(F.lit("/pic/"), s, F.lit(".jpg"))).otherwise(F.concat(F.lit("https://cdn.example/"), s, F.lit(".jpg")))
    optics = F.struct(
        F.when(i % 5 == 0, None).when(i % 5 == 1, "").otherwise(F.col("event_type")).alias("camera_manufacturer"),
        F.when(i % 6 != 0, F.concat(F.lit("M"), (i % 9).cast("string"))).alias("camera_model"),
        F.when(i % 4 != 0, F.when(i % 3 == 0, 360.0).otherwise(96.0)).alias("field_of_view"),
        F.array((i % 4000).cast("int"), (i % 3000).cast("int")).alias("sensor_array_dimensions"),
    )
    return table(spark, d, "events").select(
        s.alias("id"), F.col("user_id").cast("string").alias("collection"),
        F.struct(F.lit("Point").alias("type"), F.array((i % 360 - 180).cast("double"), (i % 180 - 90).cast("double")).alias("coordinates")).alias("geometry"),
        F.concat(root, via).alias("links"), F.create_map(F.lit("hd"), F.struct(href.alias("href"))).alias("assets"),
        F.struct(F.lit("CC").alias("license"), F.col("ts").cast("string").alias("datetime"), (i % 100).cast("int").alias("geovisio:rank_in_collection"), (i % 40).cast("double").alias("quality:horizontal_accuracy"), (i % 61).cast("double").alias("panoramax:horizontal_pixel_density"), optics.alias("pers:interior_orientation")).alias("properties"),
    )


API_SQL = "coalesce(rtrim(via, '/') || '/api', rtrim(root, '/'))"


@query(f"""with e as (select event_id, {ITEM_COLUMNS} from events), a as (select *, {API_SQL} as api from e)
select id, collection, fov >= 360 as is_pano, nullif(concat_ws(' ', nullif(maker, ''), nullif(cam, '')), '') as camera, cast(event_id % 100 as integer) as rank, (event_id % 40)::double as gps_accuracy, (event_id % 61)::double as pixel_density,
  api as instance_api, case when href like '/%' then regexp_replace(coalesce(api, ''), '/api$', '') || href else href end as hd_url from a""")
def flatten_items(spark: SparkSession, d: str) -> DataFrame:
    return ingest.flatten_items(catalogue(spark, d)).select("id", "collection", "is_pano", "camera", "rank", "gps_accuracy", "pixel_density", "instance_api", "hd_url")


@query("""select event_id::varchar as id, event_id % 100 as rank from events where event_id % 360 - 180 between 60 and 120 and event_id % 180 - 90 between -20.5 and 30""")
def bbox_search(spark: SparkSession, d: str) -> DataFrame:
    items = ingest.flatten_items(catalogue(spark, d))
    return items.filter(ingest.in_bbox(ingest.parse_bbox("60,-20.5,120,30"))).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"with {PICTURES_SQL} select id, rank from pictures where collection = '3' and rank > 5 order by rank, id limit 40")
def collection_page(spark: SparkSession, d: str) -> DataFrame:
    return sampling.collection_page(pictures(spark, d), "3", 40, 5).select("id", "rank")


@query("select d.doc_id, l.quality, l.toxic from (select doc_id from documents) d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l on l.doc_id = d.doc_id")
def join_meta(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "documents").select(F.concat(F.lit("/data/set/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    meta = table(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return ingest.join_metadata(images.select(ingest.file_stem(F.col("path")).alias("id")), meta).select(F.col("id").cast("long").alias("doc_id"), "quality", "toxic")


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def skip_known(spark: SparkSession, d: str) -> DataFrame:
    return ingest.skip_known(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("""with o as (select doc_id, lang, source from documents), n as (select doc_id * 2 as doc_id, max(quality) as quality, 'labelled' as lang from labels group by doc_id)
select coalesce(o.doc_id, n.doc_id) as doc_id, case when n.doc_id is not null then n.lang else o.lang end as lang, o.source, n.quality from o full join n on o.doc_id = n.doc_id""")
def upsert_meta(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "documents").select("doc_id", "lang", "source")
    new = table(spark, d, "labels").groupBy((F.col("doc_id") * 2).alias("doc_id")).agg(F.max("quality").alias("quality")).withColumn("lang", F.lit("labelled"))
    return ingest.upsert(old, new, "doc_id").select("doc_id", "lang", "source", "quality")


@query("select doc_id as id, lang, null as url from documents union all select page_id, null, url from pages")
def union_jobs(spark: SparkSession, d: str) -> DataFrame:
    local = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    remote = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    return ingest.union_jobs(local, remote)


@query(f"""with {PICTURES_SQL} select id, camera, case when position % 2 = 0 then privacy_blur else 0.5::double end as privacy_blur, collection from pictures""")
def join_uploads(spark: SparkSession, d: str) -> DataFrame:
    p = pictures(spark, d)
    uploads = p.select("id", F.when(F.col("position") % 2 == 1, 0.5).alias("privacy_blur"))
    return ingest.join_uploads(uploads, p).select("id", "camera", "privacy_blur", "collection")


@query(f"with {PICTURES_SQL} select id from pictures where not coalesce(gps_accuracy > 10, false) and not coalesce(pixel_density < 15, false) and not coalesce(privacy_blur > 0.05, false)")
def early_filter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.early_filter(pictures(spark, d), R.Rules(max_gps_accuracy=10)).select("id")


SAMPLE_KEY = "position * 7919 % 10007"


@query(f"""with {PICTURES_SQL}, k as (select *, {SAMPLE_KEY} as o, row_number() over (partition by camera, collection order by {SAMPLE_KEY}, position) as k from pictures qualify k <= 2),
a as (select *, row_number() over (partition by camera order by o, position) as a from k qualify a <= 100) select id, camera, collection from a""")
def sample_cap(spark: SparkSession, d: str) -> DataFrame:
    order = [F.expr(SAMPLE_KEY), F.col("position")]
    return sampling.capped(pictures(spark, d), "camera", "collection", 2, 100, order).select("id", "camera", "collection")


@query(f"""with {PICTURES_SQL} select id, collection from pictures where cast(collection as bigint) % 5 <> 0 qualify row_number() over (partition by collection order by {SAMPLE_KEY}, position) = 1""")
def sample_one_per_sequence(spark: SparkSession, d: str) -> DataFrame:
    p = pictures(spark, d)
    known = p.filter(F.col("collection").cast("long") % 5 == 0)
    return sampling.one_per_sequence(p, "collection", known, order=[F.expr(SAMPLE_KEY), F.col("position")]).select("id", "collection")


PHRASES = ["Book now! Limited offer", "50% off, was $30 now $15,50 or 12 eur", "4 days 3 nights half board", "call us +32 470 12 34 56 or www.shop.example", "happy hour deals", ""]


def _phrased(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("conv_id") % len(PHRASES) + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, phrase)).alias("text"))


def _evidence_sql(select: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    found = ", ".join(f"list_slice(list_sort(list_distinct(list_transform(regexp_extract_all(t, {quote(p)}), lambda x: trim(x)))), 1, 12) as {f}" for f, p in texts.SIGNALS.items())
    phrases = "[" + ", ".join(map(quote, PHRASES)) + "]"
    return f"""with p as (select conv_id, turn, lower(concat_ws(' ', coalesce(text, ''), case when turn % 2 = 0 then ({phrases})[conv_id % {len(PHRASES)} + 1] end)) as t from conversations),
s as (select conv_id, turn, {found} from p) select conv_id, turn, {select} from s"""


@query(_evidence_sql(", ".join(f"array_to_string({f}, '|') as {f}" for f in texts.SIGNALS)))
def commercial_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = texts.with_evidence(_phrased(spark, d))
    return found.select("conv_id", "turn", *[F.array_join(f, "|").alias(f) for f in texts.SIGNALS])


STRENGTH_SQL = "round(least(1.0::double, " + " + ".join(f"case when len({f}) > 0 then {w}::double else 0 end" for f, w in texts.WEIGHTS.items()) + " + 0.6::double * least(1.0::double, len(price) / 3.0::double)), 6)"


@query(_evidence_sql(f"{STRENGTH_SQL} as strength"))
def commercial_strength(spark: SparkSession, d: str) -> DataFrame:
    return texts.with_evidence(_phrased(spark, d)).select("conv_id", "turn", F.round("strength", 6).alias("strength"))


def _ad_inputs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(
        i.alias("id"), ((i * 13 % 97) / F.lit(400.0)).alias("reference"), F.when(i % 101 == 0, float("nan")).otherwise((i * 29 % 89) / F.lit(350.0)).alias("advertising"),
        (i % 9 != 0).alias("available"), (i % 12).cast("int").alias("words"), ((i * 3 % 31) / F.lit(1.5)).alias("area"), ((i * 7 % 11) / F.lit(10.0)).alias("commerce"),
    )


AD_SQL = """with i as (select event_id as id, (event_id * 13 % 97) / 400.0::double as r, case when event_id % 101 = 0 then 'nan'::double else (event_id * 29 % 89) / 350.0::double end as a,
  event_id % 9 <> 0 as available, event_id % 12 as words, (event_id * 3 % 31) / 1.5::double as area, (event_id * 7 % 11) / 10.0::double as commerce from events),
v as (select *, isfinite(a) as ok, 1 / (1 + exp(-greatest(-40.0::double, least(40.0::double, (a - r) / 0.012::double)))) as visual,
  case when available then least(1.0::double, area / 8.0::double) else 0 end as t, case when available then least(1.0::double, commerce) else 0 end as c from i),
s as (select *, case when ok then 100.0::double * (1 - (1 - visual) * (1 - 0.55::double * t) * (1 - 0.6::double * c)) end as score from v),
f as (select *, ok and a - r >= 0.005 and available and words >= 4 and area >= 3 and (c >= 0.45 or (a - r >= 0.04 and area >= 8)) and score >= 90 as reject from s)
"""


@query(AD_SQL + "select id, round(score, 6) as score, ok and available as complete from f")
def ad_evidence_score(spark: SparkSession, d: str) -> DataFrame:
    e = texts.evidence_score(*[F.col(c) for c in ("reference", "advertising", "available", "words", "area", "commerce")])
    return _ad_inputs(spark, d).select("id", e.alias("e")).select("id", F.round("e.score", 6).alias("score"), "e.complete")


@query(AD_SQL + """select id, case when ok and available and reject then 'reject' else 'accept' end as decision,
case when not (ok and available) then 'inconclusive_evidence' when reject then 'obvious_advertisement' else 'no_obvious_advertisement' end as reason from f""")
def ad_decision(spark: SparkSession, d: str) -> DataFrame:
    e = texts.evidence_score(*[F.col(c) for c in ("reference", "advertising", "available", "words", "area", "commerce")])
    return _ad_inputs(spark, d).select("id", e.alias("e")).select("id", texts.advert_decision(F.col("e")).alias("v")).select("id", "v.decision", "v.reason")


CATEGORY_SQL = """with c as (select label as category, vec_id, embedding as p, row_number() over (partition by label order by vec_id) as k from embeddings qualify k <= 4),
s as (select e.vec_id as id, c.category, list_cosine_similarity(e.embedding::double[], c.p::double[]) as s from embeddings e, c),
t as (select id, category, avg(s) as score from (select *, row_number() over (partition by id, category order by s desc) as k from s) where k <= 2 group by id, category),
b as (select id, max(score) filter (category < 8) as reference, max(score) filter (category >= 8) as advertising from t group by id)
select id, round(reference, 9) as reference, round(advertising, 9) as advertising from b"""


@query(CATEGORY_SQL)
def zero_shot_category(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    prompts = sampling.capped(e.withColumn("all", F.lit(0)), "all", "label", 4, order=[F.col("vec_id")], key="vec_id")
    prompts = prompts.select(F.when(F.col("label") < 8, "reference").otherwise("advertising").alias("kind"), F.col("label").alias("category"), F.col("embedding").alias("vector"))
    best = vectors.best_categories(vectors.category_scores(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), prompts))
    return best.select("id", F.round("reference.score", 9).alias("reference"), F.round("advertising.score", 9).alias("advertising"))


@query("select doc_id, case when n > 1 and doc_id <> first then first end as duplicate_of from (select doc_id, count(*) over (partition by text) as n, min(doc_id) over (partition by text) as first from documents)")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("first"))
    return docs.join(first, F.col("first").isNotNull() & docs["sha"].eqNullSafe(first["sha"])).select("doc_id", F.when(F.col("doc_id") != F.col("first"), F.col("first")).alias("duplicate_of"))


HASH_SQL = "cast(list_sum([case when embedding[8 * ((k - 1) // 7) + (k - 1) % 7 + 1] < embedding[8 * ((k - 1) // 7) + (k - 1) % 7 + 2] then (1::bigint << (k - 1)) else 0 end for k in range(1, 57)]) as bigint)"


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    """A difference hash of each vector, read as an 8 by 8 picture: each cell against its right neighbour."""
    bit = lambda k: F.when(F.get("embedding", F.lit(8 * (k // 7) + k % 7)) < F.get("embedding", F.lit(8 * (k // 7) + k % 7 + 1)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    bits = [bit(k) for k in range(56)]
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda s, x: s + x).alias("dhash"))


@query(f"with h as (select vec_id, {HASH_SQL} as h from embeddings) select a.vec_id as a, b.vec_id as b, cast(bit_count(xor(a.h, b.h)) as integer) as distance from h a join h b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) <= 14")
def near_duplicates_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.near_pairs(_hashes(spark, d), "vec_id", "dhash", 14)


@query(f"""with recursive h as (select vec_id, {HASH_SQL} as h, row_number() over (order by vec_id) as n from embeddings),
g as (select 0::bigint as n, cast([] as struct(id bigint, h bigint)[]) as seen, cast(null as bigint) as vec_id, cast(null as bigint) as dup
  union all select n, case when dup is null then list_append(seen, {{'id': vec_id, 'h': h}}) else seen end, vec_id, dup from (
    select h.n, g.seen, h.vec_id, h.h, coalesce(list_filter(g.seen, lambda x: x.h = h.h)[1].id, list_filter(g.seen, lambda x: bit_count(xor(x.h, h.h)) <= 14)[1].id) as dup from g join h on h.n = g.n + 1))
select vec_id, dup is null as kept, dup as duplicate_of from g where n > 0""")
def dedupe_greedy(spark: SparkSession, d: str) -> DataFrame:
    rows = _hashes(spark, d).withColumn("sha1", F.sha1(F.col("dhash").cast("string")))
    return dedupe.drop_duplicates(rows, position="vec_id", max_distance=14).select("vec_id", "kept", "duplicate_of")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "face").when(F.col("l_linenumber") % 3 == 1, "plate").otherwise("sign")
    box = F.array((F.col("l_partkey") % 900).cast("double"), (F.col("l_suppkey") % 700).cast("double"), 8 + F.col("l_quantity") * 4, (8 + F.col("l_linenumber") * 16).cast("double"))
    d_ = F.struct(kind.alias("class"), F.lit(0.9).alias("confidence"), box.alias("xywh"), F.lit(None).cast("array<double>").alias("bbox"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(d_).alias("detections")).withColumns({"width": F.lit(1000), "height": F.lit(800)})


AREA_SQL = """with b as (select l_orderkey, (l_partkey % 900)::double as x0, (l_suppkey % 700)::double as y0, least((l_partkey % 900) + 8 + l_quantity * 4, 1000)::double as x1, least((l_suppkey % 700) + 8 + l_linenumber * 16, 800)::double as y1,
  l_linenumber % 3 <> 2 and 8 + l_quantity * 4 >= 12 and 8 + l_linenumber * 16 >= 12 as used from lineitem),
u as (select * from b where used),
xs as (select l_orderkey, x, lead(x) over (partition by l_orderkey order by x) as nx from (select distinct l_orderkey, unnest([x0, x1]) as x from u)),
ys as (select l_orderkey, y, lead(y) over (partition by l_orderkey order by y) as ny from (select distinct l_orderkey, unnest([y0, y1]) as y from u)),
cells as (select xs.l_orderkey, (nx - x) * (ny - y) as a from xs join ys on xs.l_orderkey = ys.l_orderkey where nx is not null and ny is not null
  and exists (select 1 from u where u.l_orderkey = xs.l_orderkey and u.x0 <= x and u.x1 >= nx and u.y0 <= y and u.y1 >= ny))
select o.l_orderkey, coalesce(c.area, 0) as area, o.patches from (select l_orderkey, count(*) filter (used) as patches from b group by l_orderkey) o left join (select l_orderkey, sum(a) as area from cells group by l_orderkey) c on c.l_orderkey = o.l_orderkey"""


@query(AREA_SQL)
def privacy_union_area(spark: SparkSession, d: str) -> DataFrame:
    rows = _detections(spark, d)
    found = privacy.boxes(F.col("detections"))
    return rows.select("l_orderkey", privacy.union_area(privacy.clipped(found, F.col("width"), F.col("height"))).alias("area"), F.size(found).cast("long").alias("patches"))


@query(f"select l_orderkey, cast(format('{{:.4f}}', area / 800000.0::double) as double) as privacy_blur, cast(patches as integer) as privacy_patches, 'sgblur' as privacy_record from ({AREA_SQL})")
def privacy_blurred_share(spark: SparkSession, d: str) -> DataFrame:
    return privacy.with_blurred_share(_detections(spark, d)).select("l_orderkey", "privacy_blur", "privacy_patches", "privacy_record")


@query(f"""with {PICTURES_SQL} select position // 4 as g, round(min(quality_score), 4) as worst_quality_score, round(avg(quality_score), 7) as mean7, round(min(blurred_area), 4) as worst_blurred_area from pictures group by 1""")
def view_worst_mean(spark: SparkSession, d: str) -> DataFrame:
    views = pictures(spark, d).withColumn("g", F.floor(F.col("position") / 4))
    out = vectors.view_scores(views, "g", ["quality_score", "blurred_area"]).join(views.groupBy("g").agg(F.round(F.avg("quality_score"), 7).alias("mean7")), "g")
    return out.select("g", "worst_quality_score", "mean7", "worst_blurred_area")


@query(f"""with {PICTURES_SQL} select id, round((percent_rank() over (order by quality_score nulls first) + percent_rank() over (order by blurred_area nulls first) + percent_rank() over (order by cpbd nulls first)) / 3.0::double, 9) as consensus from pictures""")
def percentile_consensus(spark: SparkSession, d: str) -> DataFrame:
    return summary.consensus(pictures(spark, d), ["quality_score", "blurred_area", "cpbd"], "id").select("id", F.round("consensus", 9).alias("consensus"))


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 9) as norm from embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 9).alias("norm"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Pictures with a label, a variant, a shown rotation and scores that are higher for worse pictures."""
    i = F.col("position")
    return pictures(spark, d).withColumns({"label": (i * 31 % 7 < 3).cast("int"), "variant": F.concat(F.lit("v"), (i % 4).cast("string")), "shown": ((i * 3 % 8).cast("int") % 4) * 90, "flat": -F.col("cpbd"), "dull": -F.col("quality_score")})


MEASURED_SQL = f"with {PICTURES_SQL}, m as (select *, cast(position * 31 % 7 < 3 as integer) as label, 'v' || (position % 4) as variant, cast(position * 3 % 8 % 4 * 90 as integer) as shown, -cpbd as flat, -quality_score as dull from pictures)"


@query(MEASURED_SQL + """, l as (select measure, label, score from (select label, unnest(['blurred_area', 'flat', 'dull']) as measure, unnest([blurred_area, flat, dull]) as score from m) where score is not null),
r as (select *, rank() over (partition by measure order by score) + (count(*) over (partition by measure, score) - 1) / 2.0::double as r from l),
t as (select measure, count(*) filter (label = 1) as positives, count(*) filter (label = 0) as negatives, sum(r) filter (label = 1) as ranks from r group by measure)
select measure, positives, negatives, round((ranks - positives * (positives + 1) / 2.0::double) / (positives * negatives), 9) as auc from t""")
def evaluation_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc_table(_measured(spark, d), ["blurred_area", "flat", "dull"], "label").withColumn("auc", F.round("auc", 9))


@query(MEASURED_SQL + f""", f as (select *, cast(coalesce({NOT_SHARP_SQL}, false) as integer) as flag from m),
b as (select avg(flag) as rate from f where variant = 'v0'),
o as (select list(blurred_area order by blurred_area) filter (blurred_area is not null) as a, list(flat order by flat) filter (flat is not null) as c, any_value(rate) as rate from f, b where variant = 'v0'),
p as (select *, (len(a) - 1) * (1 - rate) as pa, (len(c) - 1) * (1 - rate) as pc from o),
t as (select a[floor(pa)::int + 1] + (coalesce(a[floor(pa)::int + 2], 0) - a[floor(pa)::int + 1]) * (pa - floor(pa)) as area, c[floor(pc)::int + 1] + (coalesce(c[floor(pc)::int + 2], 0) - c[floor(pc)::int + 1]) * (pc - floor(pc)) as flat from p)
select variant, count(*) as pictures, round(avg(flag), 9) as rule, round(avg(cast(blurred_area > t.area as integer)), 9) as blurred_area, round(avg(cast(f.flat > t.flat as integer)), 9) as flat from f, t group by variant""")
def evaluation_detection(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.detection_table(_measured(spark, d), "variant", "v0", R.not_sharp(RULES), ["blurred_area", "flat"])
    return out.withColumns({c: F.round(c, 9) for c in ("rule", "blurred_area", "flat")})


@query(MEASURED_SQL + """, l as (select variant, drop from (select unnest(['blurred_area', 'cpbd']) as variant, unnest([quality_score - blurred_area, quality_score - cpbd]) as drop from m) where drop is not null)
select variant, count(*) as pictures, round(median(drop), 9) as median, round(quantile_cont(drop, 0.9), 9) as p90, round(max(drop), 9) as most, count(*) filter (drop >= 0.1) as reach from l group by variant""")
def evaluation_score_drop(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.score_drops(_measured(spark, d), "quality_score", ["blurred_area", "cpbd"]).withColumns({c: F.round(c, 9) for c in ("median", "p90", "most")})


@query(MEASURED_SQL + "select shown as rotation, count(*) as pictures, count(*) filter (orientation = shown) as recognised, count(*) filter (orientation <> shown and orientation_confidence >= 0.9) as sure_but_wrong from m group by shown")
def evaluation_rotation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.rotation_table(_measured(spark, d), "shown", "orientation", "orientation_confidence")


BOXES = [(0, -30.0, -20.0, 40.0, 25.0), (1, 0.0, 0.0, 90.0, 90.0), (2, 170.0, 60.0, 180.0, 90.0), (3, 10.0, 10.0, 10.0, 10.0)]


@query(f"""with a(area, x0, y0, x1, y1) as (values {", ".join(map(str, BOXES))}), e as (select event_id, event_id % 360 - 180 as x, event_id % 180 - 90 as y from events)
select event_id::varchar as id, area from e join a on x between x0 and x1 and y between y0 and y1""")
def area_items(spark: SparkSession, d: str) -> DataFrame:
    areas = spark.createDataFrame(BOXES, "area int, lon_min double, lat_min double, lon_max double, lat_max double")
    return evaluation.area_samples(ingest.flatten_items(catalogue(spark, d)), areas).select("id", "area")


@query("""select event_id as id, case when event_id % 4 = 3 then 0 else event_id % 3 end as boxes, case when event_id % 4 < 3 and event_id % 3 > 0 then (event_id % 50)::double end as x from events""")
def header_records(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    one = F.format_string('{"class": "face", "confidence": 0.5, "xywh": [%d, 2, 30, 40]}', i % 50)
    listed = F.concat(F.lit("["), F.array_join(F.slice(F.array(one, one), F.lit(1), (i % 3).cast("int")), ", "), F.lit("]"))
    text = F.when(i % 4 == 3, "{}").when(i % 2 == 0, listed).otherwise(F.concat(F.lit('{"info": '), listed, F.lit("}")))
    return table(spark, d, "events").select(i.alias("id"), privacy.header_detections(text).alias("f")).select("id", F.size("f").cast("long").alias("boxes"), F.get(F.get("f", F.lit(0))["xywh"], F.lit(0)).alias("x"))


@query("""with w as (select event_id as id, event_id % 7 <> 0 as available, case when event_id % 100 >= 45 then 1 else 0 end as a, case when event_id * 7 % 100 >= 45 then 1 else 0 end as b, event_id % 60 + 1 as w, event_id % 40 + 1 as h from events)
select id, available, case when available then a + b else 0 end as words, case when available then round(least(100.0::double, (a + b) * w * h * 100.0::double / 30000), 6) else 0 end as area from w""")
def ocr_evidence(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    row = lambda conf, text: F.format_string("5\t1\t1\t1\t1\t1\t0\t0\t%d\t%d\t%d\t" + text, i % 60 + 1, i % 40 + 1, conf)
    head = F.lit("\t".join(["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]))
    tsv = F.when(i % 7 != 0, F.array_join(F.array(head, row(i % 100, "sale"), row(i * 7 % 100, '"quoted'), row(i * 0 + 99, " ")), "\n"))
    rows = table(spark, d, "events").select(i.alias("id"), tsv.alias("tsv"), F.lit(200).alias("w"), F.lit(150).alias("h"))
    return texts.with_ocr_evidence(rows, "tsv", "w", "h").select("id", "available", F.col("words").cast("long").alias("words"), F.round("text_area_percent", 6).alias("area"))


@query("select event_id as id, 'img' || lpad((event_id % 50)::varchar, 12, '0') || 'b' || lpad(event_id::varchar, 12, '0') || '.jpg' as key from events")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    name = F.concat(F.lit("IMG"), (i % 50).cast("string"), F.lit("b"), i.cast("string"), F.lit(".JPG"))
    return table(spark, d, "events").select(i.alias("id"), ingest.natural_key(name).alias("key"))


@query(f"with {PICTURES_SQL} select collection, id, camera from pictures qualify row_number() over (partition by collection order by position) = 1")
def first_by_id(spark: SparkSession, d: str) -> DataFrame:
    return ingest.first_by_id(pictures(spark, d), "position", "collection").select("collection", "id", "camera")


TWO_PLACES = "cast(round(cast(cast({} as varchar) as decimal(30, 20)), 2) as decimal(10, 2))"


@query(verdict_sql() + f"""select id, 'Automated detection (' || replace(issues, ',', ', ') || coalesce('; score ' || {TWO_PLACES.format("quality_score")}, '')
  || case when n >= 2 and reason is null then coalesce(' vs sequence median ' || {TWO_PLACES.format("med")}, '') else '' end || ') by ' || model as comment from judged where issues <> ''""")
def report_comment(spark: SparkSession, d: str) -> DataFrame:
    judged = judge(pictures(spark, d), RULES)
    return judged.filter(F.size("issues") > 0).select("id", summary.report_comment().alias("comment"))


@query("select page_id, replace(html, '</', '<\\/') as html from pages")
def script_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", summary.script_json(F.col("html")).alias("html"))


@query(AD_SQL + """, s2 as (select id, ok, available, reject, case when id % 50 = 0 then 'error' when id % 31 = 0 then 'unavailable' when ok and available then 'complete' else 'partial' end as status from f)
select id, status, case when status = 'error' then 'error' when status = 'unavailable' or status = 'partial' or not reject then 'accept' else 'reject' end as decision,
  case when status = 'error' then 'processing_error' when status = 'unavailable' then 'check_unavailable' when status = 'partial' then 'inconclusive_evidence' when reject then 'obvious_advertisement' else 'no_obvious_advertisement' end as reason,
  status in ('complete', 'partial') as checked from s2""")
def advert_records(spark: SparkSession, d: str) -> DataFrame:
    e = texts.evidence_score(*[F.col(c) for c in ("reference", "advertising", "available", "words", "area", "commerce")])
    rows = _ad_inputs(spark, d).select("id", e.alias("evidence"), F.when(F.col("id") % 50 == 0, "unreadable").alias("error"), F.when(F.col("id") % 31 == 0, "no model").alias("unavailable"))
    return policy.advert_records(rows).select("id", "status", "decision", "reason", "checked")


@query(f"with {PICTURES_SQL} select id, collection, rank, camera, is_pano, gps_accuracy from pictures")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "jsonl")
    files.write_jsonl(pictures(spark, d).select("id", "collection", "rank", "camera", "is_pano", "gps_accuracy"), path)
    return files.read_jsonl(spark, path, "id string, collection string, rank int, camera string, is_pano boolean, gps_accuracy double")
