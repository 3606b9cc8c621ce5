"""One thin query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclake.llm import chat_format, decontaminate, fill_middle, hmm_scoring, html_extraction, jaccard_join, language_id, mixing, packing, quality_rules, structure_repair, url_filters, warc_fixity
from civiclake.llm.registry import ORACLES, QUERIES, query, table
from civiclake.session import materialise

#: A public byte-level BPE vocabulary of 50,256 tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

__all__ = ["ORACLES", "QUERIES"]


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("_row.doc_id", *[F.col(f"_stats.{c}").alias(c) for c in counts], F.col("_base_failed").alias("base_failed"),
                         F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_class").alias("class_id"), F.col("_links").alias("n_links"),
                        F.col("_set_links").alias("n_text_links"), F.col("_copies").alias("n_copies"), F.col("_first").alias("first_copy"))


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"), F.col("_first_word").alias("first_word"),
                        F.col("_edits").alias("edits"), F.col("_item_words").alias("item_words"))


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    read, _ = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return read.select("_row.doc_id", "_row.source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"),
                       F.col("_before").alias("tokens_before"), F.col("_tokens").alias("n_tokens"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op6_hmm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm_scoring.hmm_scores(table(spark, sf_dir, "documents"))
    return scored.select(F.col("_id").alias("doc_id"), F.col("_held_out").alias("held_out"), F.col("_tokens").alias("n_tokens"),
                         F.col("_known").alias("n_known"), F.col("_train_tokens").alias("train_tokens"),
                         F.col("_base").alias("base_score"), F.col("_score").alias("score"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = language_id.identify(docs, learn=number % 4 != 2)
    return found.select(
        F.col("_id").alias("doc_id"), F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_entropy").alias("bits_per_symbol"), F.col("_accepted").alias("accepted"))


URL_RULES = (
    url_filters.Rule("allow", "com", ""), url_filters.Rule("block", "example.com", "en/"), url_filters.Rule("allow", "www.example.com", "en/"),
    url_filters.Rule("block", "net", "es/"), url_filters.Rule("block", "net", "fr/"))


@query("op3_url_filters")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("_id").alias("page_id"), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
                         F.col("_verdict").alias("verdict"), F.col("_trust").alias("trust"), F.col("_distrust").alias("distrust"))


@query("op10_warc_fixity", """
with records as (
    select page_id, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
        || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
        || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
        || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) as record
    from pages),
sized as (select page_id, octet_length(record)::bigint as length, sha256(record) as digest from records),
placed as (
    select *, ('0x' || substr(digest, 1, 8))::bigint % greatest(1, ceil((select sum(length) from sized) / 64000000.0)::bigint) as file from sized),
positioned as (
    select *, coalesce(sum(length) over (partition by file order by page_id, digest rows between unbounded preceding and 1 preceding), 0)::bigint as "offset",
        ('0x' || substr(sha256(coalesce(page_id::varchar, '')), 1, 8))::bigint % 30 as n
    from placed)
select page_id, file, "offset", length, case n when 0 then 'changed' when 1 then 'resized' else 'missing' end as kind
from positioned where n <= 2
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second replica is the first with faults in about one of ten records. It is read through the faults, not written again."""
    first = materialise(warc_fixity.archive(table(spark, sf_dir, "pages")), "archive")
    return warc_fixity.audit(first, warc_fixity.damaged(first)).select(F.col("id").alias("page_id"), "file", "offset", "length", "kind")


@query("op2_chat_format")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = chat_format.repair_turns(table(spark, sf_dir, "conversations"))
    return repaired.select(F.col("conv").alias("conv_id"), "turn", "role", "new_role", "merged", "inserted_before", "inserted_after", "cost", "piece")


def _structure_sql() -> str:
    """The repair as a recursion over rows from the last to the first. A state's best repair is one string: cost, edits, repaired turns."""
    def put(v: str, cost: str, edit: str, line: str) -> str:
        at = f"instr({v}, chr(1))"
        return (f"lpad((substr({v}, 1, 8)::int + {cost})::varchar, 8, '0') || '{edit}' || substr({v}, 9, {at} - 9) || chr(1) || {line} || substr({v}, {at} + 1)")

    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    insertion = {"e": ("u", user), "s": ("u", user), "u": ("a", assistant), "a": ("u", user)}
    inserted = ", ".join(f"least({x}, {put(to, '2', 'I', line)}) as {x}" for x, (to, line) in insertion.items())
    given, kept = "role || ':' || text || chr(10)", []
    for x, (to, _) in insertion.items():
        options = [put(x, "3", "D", "''")]
        name = "user" if to == "u" else "assistant"
        options.append(f"case when kind <> '-' then {put(to, '2 + truncated', 'R', f"'{name}:' || text || chr(10)")} end")
        options.append(f"case when kind = '{to}' then {put(to, 'truncated', 'K', given)} end")
        if x == "e":
            options.append(f"case when kind = 's' then {put('s', 'truncated', 'K', given)} end")
        kept.append(f"least({', '.join(options)}) as {x}")
    step = f"select conv_id, i, {', '.join(kept)} from (select best.conv_id, best.i - 1 as i, e, s, u, a, kind, truncated, role, text from best join faults on faults.conv_id is not distinct from best.conv_id and faults.i = best.i - 1)"
    for _ in range(3):
        step = f"select conv_id, i, {inserted} from ({step})"
    return f"""
with recursive numbered as (
    select *, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) as crc
    from conversations),
given as (
    select conv_id, turn, xor(crc, 4294967295) % 20 as draw, coalesce(role, ' ') as role, coalesce(text, ' ') as text from numbered),
damaged as (
    select conv_id, turn, case draw when 4 then 'user' else role end as role,
        case draw when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case draw when 3 then [1, 2] else [1] end) as copy
    from given where draw <> 0),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
ordered as (
    select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown
    from placed),
faults as (
    select conv_id, turn, i, role, text, case when shown = '' then 'blank' when again then 'duplicate' when right(shown, 1) not in ('.', '!', '?') then 'truncated' end as fault,
        case when shown = '' or again then '-' else left(role, 1) end as kind, case when right(shown, 1) not in ('.', '!', '?') then 1 else 0 end as truncated,
        lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
    from ordered),
sums as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
        count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
        count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
    from faults group by conv_id),
best as (
    select conv_id, n + 1 as i, '00000000' || chr(1) as e, '00000004II' || chr(1) || {user} || {assistant} as s,
        '00000002I' || chr(1) || {assistant} as u, '00000000' || chr(1) as a
    from sums
    union all
    {step}),
repaired as (
    select conv_id, substr(e, 1, 8)::bigint as cost, substr(e, 9, instr(e, chr(1)) - 9) as audit, substr(e, instr(e, chr(1)) + 1) as body
    from best where i = 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit,
    sha256(coalesce(case when length(body) > 0 then left(body, length(body) - 1) else '' end, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join sums on sums.conv_id is not distinct from c.conv_id left join repaired on repaired.conv_id is not distinct from c.conv_id
"""


@query("op12_structure_repair", _structure_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_summaries(table(spark, sf_dir, "conversations"))


def repaired_summaries(given: DataFrame) -> DataFrame:
    """Every conversation of ``given`` after damage and repair, those of which no row is left included."""
    edits = structure_repair.repair_structure(structure_repair.damaged(given), conv="conv", turn="turn", role="role", text="text")
    found = structure_repair.summaries(edits)
    zeros = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {
        "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    ids = given.select("conv_id").distinct()
    return ids.join(found, ids["conv_id"].eqNullSafe(found["conv"]), "left").select("conv_id", *[F.coalesce(c, z).alias(c) for c, z in zeros.items()])


@query("op13_fill_middle", """
with texts as (
    select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
tokens as (
    select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as u, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
        ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
    from texts),
cuts as (
    select *, len(u)::bigint as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as high,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
             when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from tokens),
parts as (
    select *, coalesce(array_to_string(u[1:low], ''), '') as p, coalesce(array_to_string(u[low + 1:high], ''), '') as m,
        coalesce(array_to_string(u[high + 1:], ''), '') as s
    from cuts)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from parts
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``restored_sha256`` is that of the text rebuilt from output and form, not of the text given."""
    done = fill_middle.restore(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"),
                       F.col("_middle_chars").alias("middle_chars"), F.sha2("_output", 256).alias("output_sha256"), F.sha2("_restored", 256).alias("restored_sha256"))


@query("op11_html_extraction", """
with articles as (
    select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(p|h1|br)>', ' ', 'g') as body from pages),
plain as (
    select page_id, url, regexp_replace(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') as body from articles),
texts as (
    select page_id, url, trim(regexp_replace(body, '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text from plain)
select page_id, url, text, length(text)::bigint as n_chars from texts
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights are learned from the pages with one article mark; the check SQL reads that mark, which all pages supplied have."""
    pages = table(spark, sf_dir, "pages")
    texts = html_extraction.extract(pages, html_extraction.learn(pages))
    return texts.select("_row.page_id", "_row.url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
