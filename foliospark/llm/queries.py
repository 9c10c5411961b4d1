"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.addresses import same_addresses
from foliospark.llm.history_store import find_repeats
from foliospark.llm.mixing import mix_pages
from foliospark.llm.names import same_names
from foliospark.llm.packing import pack_documents
from foliospark.llm.quality import classify, text_statistics
from foliospark.llm.tokens import token_sizes
from foliospark.runtime import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that repeat an earlier one."""
    return find_repeats(read_table(spark, sf_dir, "uploads"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in containers, for every limit."""
    return pack_documents(token_sizes(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "pack_limits"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = token_sizes(read_table(spark, sf_dir, "documents"), keep=("source",))
    return mix_pages(sizes, read_table(spark, sf_dir, "mix_targets"))


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every mix."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual shares and shortfalls of every mix."""
    return _mix(spark, sf_dir)[1]


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of every page."""
    return text_statistics(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are not prose."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words")).where("kind != 'prose'").select("doc_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of one party."""
    return same_names(read_table(spark, sf_dir, "entities"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of one place."""
    return same_addresses(read_table(spark, sf_dir, "entities"))


QUERIES = {"p3_found": p3_found, "p2_found": p2_found, "p8_found": p8_found, "p8_statistics": p8_statistics, "p1_found": p1_found, "p6_packed": p6_packed, "p7_mixed": p7_mixed, "p7_shares": p7_shares}


def _canonical(column: str, digits: int) -> str:
    """SQL of a hash as so many hex digits, null if it identifies nothing."""
    t = rf"regexp_replace(lower({column}), '^\s*[0-9a-z_\-]*[g-z][0-9a-z_\-]*[:=]\s*', '')"
    t = rf"regexp_replace(regexp_replace(regexp_replace({t}, '[\s:_\-{{}}\"'']', '', 'g'), '^0x', ''), '^0+', '')"
    return f"case when regexp_full_match({t}, '[0-9a-f]{{{max(1, digits - 8 if digits > 16 else digits - 6)},{digits}}}') then lpad({t}, {digits}, '0') end"


ORACLE_SQL: dict[str, str] = {
    "p1_found": f"""with r as (select upload_id, h, cast('0x' || p as ubigint) as p from (select upload_id, h, p, row_number() over (partition by upload_id order by coalesce(batch_id, -1), h nulls first, p nulls first) as rn
 from (select upload_id, batch_id, {_canonical("upload_hash", 64)} as h, {_canonical("phash", 16)} as p from uploads where upload_id is not null)) where rn = 1)
select min(a.upload_id) as first_upload_id, b.upload_id from r a join r b on a.upload_id < b.upload_id and (a.h = b.h or bit_count(xor(a.p, b.p)) <= 6) group by 2""",
    "p8_statistics": r"""with c as (select list(distinct lower(word)) as cw from common_words where word is not null),
l as (select doc_id, line, regexp_extract_all(line, '\p{L}+') as ws from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) where regexp_matches(line, '\S')),
f as (select doc_id, line, ws, len(list_filter(ws, lambda w: list_contains(cw, lower(w)))) as known from l, c),
s as (select doc_id, sum(len(ws)) as w, count(*) as n, sum(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)) as letters, sum(len(regexp_extract_all(line, '\S'))) as signs, sum(len(regexp_extract_all(line, '[0-9]'))) as digits,
 sum(len(list_filter(ws, lambda w: regexp_matches(w, '^\p{Lu}')))) as upper, sum(cast(regexp_matches(line, '[.,;:!?"'']\s*$') as int)) as ends, sum(known) as known, sum(cast(known = 0 as int)) as bare, sum(cast(regexp_matches(line, '^\s*\p{Ll}') as int)) as low,
 sum(len(regexp_extract_all(line, '\S+'))) as tokens, sum(len(list_filter(ws, lambda w: length(w) = 1))) as single from f group by 1)
select doc_id, cast(coalesce(w, 0) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_lines, case when w > 0 then cast(letters as double) / w else 0.0 end as mean_word_length,
case when signs > 0 then cast(greatest(0, signs - letters - digits) as double) / signs else 0.0 end as symbol_ratio, case when signs > 0 then cast(digits as double) / signs else 0.0 end as digit_ratio, case when w > 0 then cast(upper as double) / w else 0.0 end as upper_ratio,
case when n > 0 then cast(ends as double) / n else 0.0 end as line_end_share, case when w > 0 then cast(known as double) / w else 0.0 end as common_share, case when n > 0 then cast(bare as double) / n else 0.0 end as bare_line_share,
case when n > 0 then cast(low as double) / n else 0.0 end as lower_start_share, case when n > 0 then cast(tokens as double) / n else 0.0 end as tokens_per_line, case when w > 0 then cast(single as double) / w else 0.0 end as single_share
from (select distinct doc_id from documents where doc_id is not null) left join s using (doc_id)""",
}
