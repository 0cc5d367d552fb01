"""The registered queries of the corpus operators, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenstack.llm import alignment, bpe, decontamination, epsilon_grid, langid, lexical, licences, packing, sharding, simhash, suffix_dedup, token_files, toxicity
from lumenstack.llm.components import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _definition() -> str:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op1_interleave_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave_shards(_table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _remainder(divisor: int) -> Column:
    """The remainder of crc32 of the id as text; null ids count as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _remainder(4) == 2)
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), bpe.Vocabulary(ranks, public_tokenizers.PATTERN))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_remainder(5) == 0).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").filter(_remainder(5) != 0)
    model = toxicity.fit(docs.filter(~F.col("held_out")), labels)
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(_table(spark, sf_dir, "documents"), length=50)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), definition, path, end_id=0)
    return token_files.token_index(token_files.read_tokens(spark, path))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=2, words=3)
    return found.select("doc_id", "fingerprint", "component_id")


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_grid.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)


def op10_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _definition(), capacity=2048, end_id=0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    found = alignment.align_and_score(_table(spark, sf_dir, "documents"), _definition(), model, relation="end")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op1_interleave_shards": op1_interleave_shards,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_template_decontamination": op8_template_decontamination,
    "op9_epsilon_grid": op9_epsilon_grid,
    "op10_licence_rules": op10_licence_rules,
    "op11_pack_sequences": op11_pack_sequences,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_alignment": op13_token_alignment,
}

#: CRC-32 of a text's bytes, by a table of its polynomial.
_CRC = """
  bits as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0,0,0,0,0,0,0,0]), lambda a, b:
      case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end)) as tbl)"""

def _licence_sql() -> str:
    """The scan in SQL: the same sentences and rules as tables."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in licences.SENTENCES.items())
    rules = ", ".join(f"('{r.licence}', '{licences.rule_pattern(r)}')" for r in licences.RULES)
    cut = """select doc_id, way, unnest(string_split_regex(regexp_replace(regexp_replace(t, '(?i)(identifier):', '\\1', 'g'),
        '[.!?;:]+(\\s|$)', chr(10), 'g'), '[\\r\\n]+')) as s, generate_subscripts(string_split_regex(regexp_replace(regexp_replace(t,
        '(?i)(identifier):', '\\1', 'g'), '[.!?;:]+(\\s|$)', chr(10), 'g'), '[\\r\\n]+'), 1) as n"""
    return f"""
with known(s, id) as (values {known}), rules(licence, pattern) as (values {rules}),
  t as (select doc_id, 0 as way, text as t from documents where regexp_matches(text, '{licences.CUE}')
    union all select doc_id, 1, regexp_replace(text, '[\\r\\n]+[\\s*#/]*', ' ', 'g') from documents where regexp_matches(text, '{licences.CUE}')),
  c as ({cut} from t),
  f as (select doc_id, way, string_agg(id, ',' order by n) as ids, count(*) as k
    from c join known on known.s = trim(regexp_replace(lower(c.s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))
    where regexp_matches(c.s, '{licences.CUE}') group by doc_id, way),
  b as (select doc_id, arg_max(ids, k * 2 + (1 - way)) as sentences from f group by doc_id)
select doc_id, sentences, coalesce((select string_agg(distinct licence, ',' order by licence) from rules
  where regexp_matches(' ' || replace(sentences, ',', ' ') || ' ', pattern)), '') as licences from b"""


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op12_ranked_search": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as words from documents),
  s as (select r, doc_id, len(words) as n from d where len(words) > 0),
  t as (select count(*) as all_docs, sum(n)::bigint as all_terms from s),
  q as (select distinct item_id, unnest({_WORDS}) as term from benchmark),
  p as (select r, term, count(*) as tf from (select r, unnest(words) as term from d) where term in (select term from q) group by all),
  w as (select term, floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1)))::bigint as w from p, t group by term),
  i as (select p.r, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))) as score
    from p join w using (term) join s using (r), t),
  x as (select item_id, doc_id, sum(score)::bigint as score from i join q using (term) join s using (r) group by item_id, r, doc_id)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from x where score > 0)
where rank <= 10""",
    "op10_licence_rules": _licence_sql(),
    "op5_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
  w as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(len(h) // 2 - 49)) as p from d where len(h) >= 100)),
  hit as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by s) as first_id from w) where first_id < doc_id),
  gone as (select distinct doc_id, p + unnest(range(50)) as b from hit),
  bytes as (select d.doc_id, x.b, substr(d.h, 2 * x.b + 1, 2) as c from d, lateral (select unnest(range(len(d.h) // 2)) as b) x),
  kept as (select bytes.doc_id, string_agg(c, '' order by bytes.b) as h from bytes anti join gone using (doc_id, b) group by bytes.doc_id),
  n as (select doc_id, count(*) as n_removed, sum((not exists_before)::int) as n_spans from (
    select doc_id, b, coalesce(lag(b) over (partition by doc_id order by b) = b - 1, false) as exists_before from gone) group by doc_id)
select d.doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept.h, ''))) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)""",
    "op9_epsilon_grid": """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
      and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
  links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.98),
  reach(node, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from reach r join links l on l.a = r.node),
  c as (select node, min(root) as component_id from reach group by node)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.node = e.vec_id""",
    "op1_interleave_shards": f"""
with {_CRC},
  d as (select doc_id, source, coalesce(text, '') as text, md5('42:' || coalesce(doc_id::varchar, '')) as h from documents),
  c as (select doc_id, source, h, (octet_length(encode(text)) + 1)::bigint as size, list_transform(string_split(
      regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::bigint) as bytes from d),
  e as (select doc_id, source, h, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, b:
      xor(a >> 8, tbl[xor(a & 255, b) + 1])))::bigint as text_crc32 from c, bits),
  r as (select *, row_number() over (partition by source order by h, doc_id nulls first, text_crc32, size) - 1 as k,
      count(*) over (partition by source) as n from e),
  p as (select *, row_number() over (order by (2.0::double * k + 1) / (2.0::double * n), source nulls first) - 1 as place, count(*) over () as total from r),
  s as (select *, (place * 16 // total)::int as shard from p)
select doc_id, size, text_crc32, 'rows' as law, shard, (place - (shard * total + 15) // 16)::bigint as slot, null::int as grown_shard from s""",
}
