"""One query per operator over the whole driver tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmill.llm import (
    ann, decontaminate, jaccard, langid, passages, periodic, quality, segment, shards, simhash, transcripts, warc, whitening,
)
from labelmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
SHARDS = 24
#: The vocabulary file is read where it is installed; another path can be set.
PIECES = os.environ.get("LABELMILL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = warc.archive(spark, table(spark, folder, "pages"), "page_id", "url", "html")
    # Payloads are inflated again and held against their digests.
    names = ("record_type", "record_id", "refers_to", "payload_digest", "payload_bytes", "target_uri")
    found = warc.read(spark, path, names, verify="true")
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:row:(-?[0-9]*)$", 1), F.lit("")).cast("long")
    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"),
    )


@query
def op2_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), k=5, every=50)


@query
def op3_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    return passages.classes(table(spark, folder, "documents"))


@query
def op4_n_best_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = segment.load(PIECES)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = segment.encode(docs, model, n=3)
    others = F.transform("alternatives", lambda x: F.struct(x["score"].alias("score"), F.size(x["ids"]).alias("n_pieces"), F.xxhash64(x["ids"]).alias("ids_hash")))
    # Alternatives become digests before the best ids are decoded, so that they do not travel twice.
    found = found.select(
        "doc_id", "text", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score", others.alias("alternatives"), "ids",
    )
    out = segment.decode(found, model)
    return out.select("doc_id", "n_pieces", "ids_hash", "score", "alternatives", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op5_sampled_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, folder, "documents").select(
        "doc_id", F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"),
    )
    out = shards.assign(docs, SHARDS, F.col("bytes") + 8, F.col("key"), "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_covering_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", quality.graded(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality.fit(docs.join(labels, "doc_id"), grades=3)
    out = quality.rate(docs, model)
    return out.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def marked(turns: DataFrame) -> DataFrame:
    """Conversations as raw transcripts: each one has its style of speaker markers, and every eighth turn after the first only
    a dash."""
    style, dash = F.pmod(F.xxhash64("conv_id"), F.lit(len(transcripts.STYLES))), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    mark = F.lit("")
    for i, names in enumerate(transcripts.STYLES):
        for role, own in names.items():
            mark = F.when((style == i) & (F.col("role") == role), F.lit(own)).otherwise(mark)
    mark = F.when(dash & (F.col("turn") > 0), F.lit("- ")).otherwise(mark)
    return turns.withColumn("line", F.concat(mark, F.coalesce("text", F.lit(""))))


@query
def op8_markov_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    turns = marked(table(spark, folder, "conversations"))
    model = transcripts.fit(turns.where("pmod(crc32(cast(conv_id as string)), 3) <> 1"), "conv_id", "turn", "line", "role")
    out = transcripts.render(transcripts.parse(turns, model, "conv_id", "turn", "line"))
    return out.select(F.col("key").alias("conv_id"), "part", F.size("roles").cast("long").alias("n_turns"), "roles", F.sha2("rendered", 256).alias("rendered_sha256"))


@query
def op9_prefix_filtered_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_naive_bayes_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


@query
def op11_feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows, "embedding")
    found = whitening.whiten(rows, model, "embedding").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return found.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def with_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with words repeating to the end of the text in every tenth document, by the hash of its id."""
    code = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(code / 10).cast("long")

    def repeating(words):  # noqa: ANN001, ANN202
        n = F.size(words)
        a = F.pmod(g, n.cast("long")).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))).cast("int")) + 1).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")

    # The words are bound once, by a lambda over an array of one.
    cut = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    made = F.transform(cut, lambda words: F.when(F.size(words) > 0, repeating(words)).otherwise(F.lit("")))
    return docs.withColumn("text", F.when((F.pmod(code, F.lit(10)) == 0) & F.col("text").isNotNull(), F.get(made, F.lit(0))).otherwise(F.col("text")))


@query
def op12_baier_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_tails(table(spark, folder, "documents").select("doc_id", "text"))
    found = periodic.find(docs).drop("text")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # The greatest length first, then the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return out.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query
def op13_blocked_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(table(spark, folder, "documents"))


#: Words at a distance q that are equal for six places in a row lie in what may be a run of period q; of the periods of one stretch the smallest is its own.
_RUNS_SQL = r"""
with h as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w,
  xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint),
    lambda c, b: list_reduce([xor(c, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint) as h from documents),
a as (select *, len(w)::bigint as n, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from h),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
d as (select doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from p),
s as (select doc_id, t, w[t + 1 : t + 6] as six from (select doc_id, w, unnest(range(n - 5)) as t from d where n >= 12)),
m as (select x.doc_id, x.t, y.t - x.t as q from s x join s y on x.doc_id = y.doc_id and x.six = y.six and x.t < y.t),
i as (select doc_id, q, t, t - row_number() over (partition by doc_id, q order by t) as island from m),
r as (select doc_id, min(t) as start, count(*) + 5 + q as length, q from i group by doc_id, q, island),
runs as (select doc_id, start, length, min(q) as period from r where length >= greatest(12, 2 * q) group by doc_id, start, length),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from (select doc_id, unnest(w) as word, unnest(range(n)) as i from d) anti join gone using (doc_id, i) group by doc_id),
best as (select *, row_number() over (partition by doc_id order by length desc, start, period) as k from runs),
all_runs as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period,
  (1000 * length // period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join all_runs using (doc_id) left join kept using (doc_id) left join (select * from best where k = 1) b using (doc_id)"""

_JACCARD_SQL = r"""
with recursive d as materialized (select row_number() over (order by doc_id) as row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
g as materialized (select distinct row, array_to_string(w[s : s + 3], ' ') as gram from (select row, w, unnest(range(1, greatest(2, len(w) - 2))) as s from d where len(w) > 0)),
n as materialized (select row, count(*) as n from g group by row),
o as (select x.row as a, y.row as b, count(*) as o from g x join g y on x.gram = y.gram and x.row < y.row group by all),
l as materialized (select a, b from o join n x on a = x.row join n y on b = y.row where 100 * o >= 85 * (x.n + y.n - o)),
e as materialized (select a, b from l union select b, a from l),
c(row, root) as (select a, a from e union select e.b, c.root from c join e on c.row = e.a where c.root <= e.b)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(r.doc_id, d.doc_id) as component_id
from d left join n using (row) left join (select c.row, min(x.doc_id) as doc_id from c join d x on c.root = x.row group by c.row) r using (row)"""


def oracle_sql() -> dict[str, str]:
    """The results that SQL can express. Hash families, samples and trained models are tested against brute force."""
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = rf"coalesce(regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    base32 = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {5 * i + 1}, 5))::bigint >> {k}) & 31)::int + 1, 1)"
        for i in range(8) for k in (15, 10, 5, 0)
    )
    return {
        "op1_warc_round_trip": f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as sha from pages),
g as (select body, max(page_id) as first from p group by body)
select page_id, strlen(body)::bigint as payload_bytes, {base32} as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from p join g using (body)""",
        "op9_prefix_filtered_decontamination": f"""
with d as (select doc_id, {cut} as w, len(w)::bigint as n_words from documents),
i as (select cast(item_id as varchar) as item_id, {cut} as w, least(13, len(w)) as n from benchmark where len({cut}) > 0),
iw as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as g
       from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as s from i)),
dw as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from iw) k where len(w) >= n)),
h as (select doc_id, s, n, item_id from dw join iw using (n, g)),
p as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(s, s + n)) as p from h) group by doc_id),
t as (select doc_id, count(*)::bigint as n_items, string_agg(item_id, ',' order by item_id) as ids
      from (select distinct doc_id, item_id from h) group by doc_id)
select doc_id, n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= n_words as contaminated
from d left join p using (doc_id) left join t using (doc_id)""",
        "op12_baier_runs": _RUNS_SQL,
        "op13_blocked_jaccard": _JACCARD_SQL,
    }
