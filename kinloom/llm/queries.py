"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import crf_langid, fair_mix, multiset_hash, packing, parity_join, pseudo_likelihood, risk_rules, rotation, unigram_count, warc
from kinloom.llm.common import cut, new_path, parts, table

CAPACITY = 1024


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    written = cut(warc.write(table(spark, sf_dir, "pages"), folder), "archives")
    warc.drop_orphans(written, folder)
    return warc.read(written, parts(spark), payloads=False).drop("url")


def op2_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.groups(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    made = packing.pieces(docs, CAPACITY, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(cut(made, "pieces"), CAPACITY)


def op4_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rotation.rotate(table(spark, sf_dir, "conversations"))
    runs = F.zip_with("mask_len", "mask_on", lambda n, on: F.concat(n.cast("string"), F.when(on, "+").otherwise("-")))
    return got.select("conv_id", "participant", "n_turns", "text", F.array_join(runs, " ").alias("mask"), "trained_chars")


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare_edited(table(spark, sf_dir, "documents"))


def op7_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_langid.identify(table(spark, sf_dir, "documents"))


def op8_unigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return unigram_count.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix_counts(table(spark, sf_dir, "documents"), lambda df: cut(df, "mix"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_parity_join, op3_packing, op4_rotation, op5_pseudo_likelihood, op6_multiset_hash, op7_crf_langid, op8_unigram_count, op9_risk_rules, op10_fair_mix)}
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') html, min(page_id) over (partition by coalesce(html, '')) first from pages),
        h as (select *, sha1(html) hex from p)
        select page_id, strlen(html)::bigint payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(hex, ((i // 4) * 5 + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::bigint, 1)), '') payload_digest,
            case when page_id = first then 'response' else 'revisit' end record_type,
            case when page_id <> first then first end refers_to
        from h""",
    "op4_rotation": """
        with t as (select conv_id, case when conv_id is null then row_number() over () end alone, turn is null late, turn, coalesce(role, 'unknown') role, coalesce(text, '') said from conversations),
        p as (select distinct conv_id, alone, role participant from t where role <> 'system'),
        s as (select p.conv_id, p.alone, participant, late, turn, role, said, role = participant own,
            '<|im_start|>' || case when role = 'system' then role when role = participant then 'assistant' else 'user name=' || role end || chr(10) h,
            said || '<|im_end|>' || chr(10) b from t join p on t.conv_id is not distinct from p.conv_id and t.alone is not distinct from p.alone)
        select conv_id, participant, count(*)::bigint n_turns, string_agg(h || b, '' order by late, turn, role, said) as text,
            string_agg(case when own then length(h) || '- ' || length(b) || '+' else (length(h) + length(b)) || '-' end, ' ' order by late, turn, role, said) mask,
            sum(case when own then length(b) else 0 end)::bigint trained_chars
        from s group by conv_id, alone, participant""",
    "op10_fair_mix": r"""
        with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
            case when source is null then '1' else '0' || source end k, md5('mix:' || coalesce(doc_id::varchar, '')) h from documents),
        per as (select k, sum(size)::bigint s, row_number() over (order by k) - 1 rk from d group by k),
        w as (select *, ([5, 2, 1])[(rk % 3) + 1]::double w, (2 * s)::double cap from per),
        lv as (select *, row_number() over (order by cap / w, rk) cr,
            (1.5 * sum(s) over ()::double - coalesce(sum(cap) over (order by cap / w, rk rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by cap / w, rk rows between current row and unbounded following) lvl from w),
        fin as (select arg_min(lvl, cr) f from lv where cap / w > lvl),
        tg as (select k, rk, s, least(cap, coalesce((select f from fin) * w, cap)) target from lv),
        q as (select d.*, rk, s, target, sum(size) over (partition by d.k order by h, doc_id, size rows unbounded preceding)::bigint run from d join tg on d.k = tg.k),
        e as (select *, unnest([run::double / target, (run + s)::double / target]) f from q where target > 0 and size > 0),
        c as (select *, sum(size) over (order by f, rk, h, doc_id, run rows unbounded preceding) upto from e),
        n as (select doc_id, h, run, count(*) n from c where upto <= (select floor(1.5 * sum(s)) from per) group by all)
        select q.doc_id, q.size, s source_size, target, (coalesce(n, 0) * q.size)::bigint taken
        from q left join n on q.doc_id = n.doc_id and q.h = n.h and q.run = n.run""",
}
