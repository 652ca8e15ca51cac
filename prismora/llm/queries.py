"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, lm_score, mixing, near_dedup, quality, secret_scan, token_counts, token_files
from .shared import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even doc_ids are the immutable snapshot, the others the incoming batch."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir), snapshot=F.col("doc_id") % 2 == 0)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), words=4).drop("text_key")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(*chat.prefix_tree(given.unionByName(more)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token that crosses a line's end goes to the line of its first byte."""
    return token_counts.line_counts(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_ids(documents(spark, sf_dir))
    return token_files.read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("body").alias("ids_crc32"))


def pipeline() -> object:
    """The module at the repository's top, or None where that file is not there; errors inside it are raised."""
    if importlib.util.find_spec("corpus_pipeline") is None:
        return None
    return importlib.import_module("corpus_pipeline")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    stages = pipeline()
    found = [op1_exact_dedup, op2_minhash_near_dedup, op3_lm_scoring, op4_secret_scan, op5_byte_bpe, op6_chat_format, op7_token_counts, op8_quality_rules, op9_mixing, op10_token_files]
    return {f.__name__: f for f in found} | ({"pipeline": stages.run} if stages else {})


#: Words of a text as the contracts define them.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_CONTROL = "</s>[INST] ok [/INST]"


def _escaped(c: str) -> str:
    return rf"regexp_replace({c}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')"


def oracle_sql() -> dict[str, str]:
    stages = pipeline()
    out = {
        "op1_exact_dedup": f"""
with n as (select doc_id, {_LOWER} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n""",
        "op2_minhash_near_dedup": f"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w),
n as (select doc_id, count(*) as n from s group by all),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
d as (select x, y from e union all select y, x from e),
reach as (select doc_id as k, doc_id as m from documents union select r.k, d.y from reach r join d on d.x = r.m),
least as (select k, min(m) as m from reach group by all)
select doc_id, coalesce(n, 0)::bigint as n_shingles, m as component_id, doc_id = m as kept from documents join least on k = doc_id left join n using (doc_id)""",
        "op6_chat_format": f"""
with t as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations union all select -1, 0, 'user', '{_CONTROL}' union all select -1, 1, 'assistant', '{_CONTROL}')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) as turns_sha256, coalesce(sum(length(t)) filter (where r = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (where r = 'assistant'), '')) as loss_sha256, sum(20 + length({_escaped('r')}) + length({_escaped('t')}))::bigint as formatted_chars
from t group by all""",
    }
    return out | ({"pipeline": stages.ORACLE_SQL} if stages and stages.ORACLE_SQL else {})
