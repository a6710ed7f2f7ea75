"""One thin query per operator, over its whole table; and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, language, lines, mixing, nearvec, quality, repair, sharding, simhash, topk, warc
from .shared import parts, shared_folder, staged, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, path = sharding.shuffled_shards(table(spark, sf_dir, "documents")), f"{shared_folder(spark)}/shards/{uuid.uuid4().hex}"
    sharding.write_shards(made, path)
    rows = spark.read.schema(made.schema).parquet(path)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.formatted(turns.union(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def bpe_digests(spark: SparkSession, docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs' texts, encoded and decoded; with_ids adds the ids."""
    ranks = bpe.load_ranks(ranks_path)
    shared = spark.sparkContext.broadcast(ranks)
    rows = bpe.encoded(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN).select("doc_id", "ids")

    def digests(batches):
        decode = bpe.decoder(shared.value)
        for b in parts(batches):
            ids = [x.values.to_numpy() for x in b.column("ids")]
            own = [sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [sha256(decode(x)).hexdigest() for x in ids]
            columns = [b.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[b.column("ids")] * with_ids], [*names, *["ids"] * with_ids])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return rows.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvec.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.page_index(spark, path)


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = table(spark, sf_dir, "documents").select("doc_id", "text"), [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    tokens = staged(align.encoded(docs, *paths).drop("text"))
    made = align.aligned(tokens, align.pair_table(tokens, *paths), *paths)
    return made.select("doc_id", *align.NUMBERS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(turns), turns)[0]


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    made = language.identified(docs.select("doc_id", "text"), language.profiles(docs.where(~held_out)))
    return made.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    own = [op1_mix_sources, op2_quality, op3_shuffled_shards, op4_top_inner_products, op5_chat_windows, op6_line_dedup, op7_simhash, op8_byte_bpe, op9_near_vectors, op10_warc]
    own += [op11_align_tokenizers, op12_repair_conversations, op13_language]
    return {f.__name__: f for f in own}


_DIGITS = "cast(('0x' || substr(md5({}), 1, 8)) as bigint)"

_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(key, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295)"""


def _edit(cost: str, edit: str, row: str, after: str, when: str = "true") -> str:
    """A way on as (cost, audit, repaired lines), at a price beyond all others where it is not allowed."""
    return f"{{'c': {after}.c + {cost} + case when {when} then 0 else 1000000000 end, 'a': '{edit}' || {after}.a, 't': {row} || {after}.t}}"


def _row_edits(own: str, role: str) -> str:
    """The best of delete, keep and rerole in a state; role: which may follow, and the first state also allows s."""
    keeps = [("u", "u"), ("s", "s")] if own == "z" else [(role, role)]
    ways = [_edit("3", "D", "''", own)] + [_edit("late", "K", "chr(10) || role || ':' || text", after, f"initial = '{r}' and not gone") for r, after in keeps]
    name = {"u": "user", "a": "assistant"}[role]
    return f"least({', '.join([*ways, _edit('late + 2', 'R', f"chr(10) || '{name}:' || text", role, 'not gone')])})"


_INSERT = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}

ORACLE_SQL = {
    "op12_repair_conversations": f"""
with recursive b as (select *, {_CRC32} % 20 as k from (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
   coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations)),
 d as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
   case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when k = 3 then [0, 1] else [0] end) as copy from b where k <> 0),
 o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as pos from d),
 f as (select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by pos) as before,
   case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
    when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from o),
 w as (select conv_id, pos, role, text, initial, fault in ('blank', 'duplicate') as gone, case when fault = 'truncated' then 1 else 0 end as late from f),
 r as (select conv_id, max(pos) + 1 as pos, {{'c': 0, 'a': '', 't': ''}} as z, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} as s,
   {{'c': 2, 'a': 'I', 't': chr(10) || 'assistant:'}} as u, {{'c': 0, 'a': '', 't': ''}} as a from w group by conv_id
  union all
  select conv_id, pos, least(z, {_edit("2", "I", _INSERT["u"], "u")}) as z, least(s, {_edit("2", "I", _INSERT["u"], "u")}) as s, u, a from (
   select conv_id, pos, z, s, least(u, {_edit("2", "I", _INSERT["a"], "a")}) as u, least(a, {_edit("2", "I", _INSERT["u"], "u")}) as a from (
    select r.conv_id, w.pos, {_row_edits("z", "u")} as z, {_row_edits("s", "u")} as s, {_row_edits("u", "a")} as u, {_row_edits("a", "u")} as a
    from r join w on r.conv_id is not distinct from w.conv_id and w.pos = r.pos - 1))),
 n as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
   count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
 cast(coalesce(z.c, 0) as bigint) as cost, coalesce(z.a, '') as audit, sha256(coalesce(substr(z.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id left join r on r.conv_id is not distinct from c.conv_id and r.pos = 1""",
    "op1_mix_sources": f"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size, coalesce(cast(doc_id as varchar), md5(text), '') as own from documents),
 s0 as (select source, sum(size)::bigint as source_size, count(*) as n from d group by source),
 s1 as (select *, row_number() over (order by source asc nulls last) - 1 as rk from s0),
 s2 as (select *, case rk % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, source_size * 2.0::double as cap from s1),
 s3 as (select *, row_number() over (order by cap / w, rk) as pos,
   sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, rk rows between unbounded preceding and 1 preceding), 0.0::double) as lft,
   sum(w) over () - coalesce(sum(w) over (order by cap / w, rk rows between unbounded preceding and 1 preceding), 0.0::double) as wl from s2),
 s4 as (select *, lft / wl as lvl, min(case when cap > w * (lft / wl) then pos end) over () as opn from s3),
 s5 as (select *, max(case when pos = opn then lvl end) over () as level from s4),
 s6 as (select source, source_size, n, case when opn is null or pos < opn then cap else w * level end as target from s5),
 r0 as (select d.doc_id, d.source, d.size, d.own, s6.source_size, s6.target,
   {_DIGITS.format("own")} % cast(ceil(n / 1000.0::double) as bigint) as bucket,
   case when source_size > 0 then cast(round(target / source_size * 67108864.0::double) as bigint) else 0 end as units
   from d join s6 on d.source is not distinct from s6.source),
 r1 as (select *, coalesce(sum(units) over (partition by source order by bucket, size, doc_id nulls last, own rows between unbounded preceding and 1 preceding), 0)::bigint
   + {_DIGITS.format("'17:' || coalesce(source, chr(0))")} % 67108864 as low from r0)
select doc_id, size, source_size, target, (((low + units) // 67108864) - (low // 67108864)) * size as taken from r1""",
    "op4_top_inner_products": """
with v as (select vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
 p as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
    "op6_line_dedup": """
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
 l as (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
 k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
 bad as (select key from k where key <> '' group by key having count(distinct r) >= 10)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(bad.key) as bigint) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by i) filter (where bad.key is null), '')) as kept_sha256
from k left join bad on k.key = bad.key group by r, doc_id""",
    "op10_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as h from pages),
 f as (select *, case when n >= 100 then min(page_id) over (partition by h) else page_id end as f from p)
select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
 case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to from f""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
