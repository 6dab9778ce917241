"""The registered queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (conversations, decontaminate, embeddings, exact_dedup, html_text, licenses, line_dedup, merkle,
                           passages, privacy, quality, sentencepiece, simhash)
from sightline.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_line_dedup", f"""
    with d as (select *, string_split(text, chr(10)) as parts from documents),
    l as (select doc_id, source, unnest(parts) as line, unnest(range(len(parts))) as pos from d),
    n as (select *, trim({_LOWER.replace("text", "line")}, ' ') as norm from l),
    m as (select *, row_number() over (partition by norm order by doc_id, pos) as nth from n),
    s as (select norm from n where norm <> '' group by norm having count(distinct source) >= {line_dedup.MIN_SITES}),
    k as (select m.*, (s.norm is null or nth = 1) as stays from m left join s using (norm))
    select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where stays), '') as text,
           count(*) as n_lines, count(*) filter (where not stays) as n_removed
    from k group by doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs, n_lines="n_lines", n_removed="n_removed").drop("source")


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(read(spark, sf_dir, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


_WORDS = "regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op4_decontaminate", f"""
    with d as (select doc_id, {_WORDS.format(lower=_LOWER)} as w from documents),
    b as (select item_id, {_WORDS.format(lower=_LOWER)} as w from benchmark),
    e as (select *, least(13, len(w)) as size from b where len(w) > 0),
    i as (select distinct item_id, size, array_to_string(w[p:p + size - 1], ' ') as span
          from (select *, unnest(range(1, len(w) - size + 2)) as p from e)),
    sizes as (select distinct size from i),
    x as (select doc_id, size, w, unnest(range(1, len(w) - size + 2)) as p from d, sizes where len(w) >= size),
    h as (select doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') as span from x),
    hits as (select h.*, i.item_id from h join i using (size, span)),
    covered as (select doc_id, count(distinct spot) as n_hit
                from (select doc_id, unnest(range(p, p + size)) as spot from hits) group by doc_id),
    named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
              from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(items, '')) as items_sha256,
           coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join covered using (doc_id) left join named using (doc_id)""")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_privacy")
def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymise(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_passages", f"""
    with d as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
               from documents),
    x as (select doc_id, unnest(range(0, len(w) - {passages.SPAN} + 1)) as p, w from d where len(w) >= {passages.SPAN}),
    h as (select doc_id, p, md5(array_to_string(w[p + 1:p + {passages.SPAN}], ' ')) as span from x),
    r as (select doc_id, p from h where span in (select span from h group by span having count(*) > 1)),
    g as (select *, p - lag(p) over (partition by doc_id order by p) > {passages.SPAN} as apart from r),
    n as (select *, sum(case when apart is distinct from false then 1 else 0 end)
                    over (partition by doc_id order by p) as run from g)
    select doc_id, min(p) as start, max(p) + {passages.SPAN} - min(p) as n_words from n group by doc_id, run""")
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op8_html")
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op9_exact_dedup", f"""
    with d as (select doc_id, sha256({_LOWER}) as text_sha256 from documents)
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
           doc_id = max(doc_id) over w as kept, text_sha256
    from d window w as (partition by text_sha256)""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read(spark, sf_dir, "documents"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.as_hex(simhash.near_duplicates(read(spark, sf_dir, "documents")))
    return grouped.selectExpr("id as doc_id", "fingerprint", "component as component_id")


def _tree_sql(name: str, base: str, levels: int = 6) -> str:
    """CTEs of a 16-ary tree per key over ``base`` (k, i, h): nodes of each level, its root, and the siblings of each leaf."""
    parts = [f"{name}0 as (select k, i, h, count(*) over (partition by k) as n from {base})"]
    for v in range(levels):
        parts.append(f"""{name}{v + 1} as (select k, i // 16 as i,
            case when any_value(n) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h,
            (any_value(n) + 15) // 16 as n from {name}{v} group by k, i // 16)""")
    return ",\n    ".join(parts)


def _walk_sql(name: str, tree: str, start: str, levels: int = 6) -> str:
    """CTEs that fold every row of ``start`` (k, i, folded, proof) up its tree, level by level."""
    parts, last = [], start
    for v in range(levels):
        side = "(select coalesce(string_agg(t.h, '' order by t.i), '') from {0} t where t.k = w.k and t.i // 16 = w.spot // 16 and t.i {1} w.spot)"
        parts.append(f"""{name}{v}a as (select w.*, {side.format(tree + str(v), "<")} as l, {side.format(tree + str(v), ">")} as r,
            (select any_value(n) from {tree}{v} t where t.k = w.k) as n from {last} w)""")
        parts.append(f"""{name}{v} as (select * exclude (l, r, n, spot, folded, proof), spot // 16 as spot,
            case when n > 1 then sha256(l || folded || r) else folded end as folded, proof || l || r as proof from {name}{v}a)""")
        last = f"{name}{v}"
    return ",\n    ".join(parts)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({0}, ''),
    lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"""


@query("op11_merkle", f"""
    with d as (select *, case when {_CRC.format("cast(doc_id as varchar)")} % 5 = 0
                         then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other
               from documents),
    f as (select *, {" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))} as head from d),
    l as (select doc_id, source, sha256(head || {_field_sql("text")}) as leaf, sha256(head || {_field_sql("other")}) as other
          from f),
    g as (select source, row_number() over (order by source nulls first) as k from (select distinct source from documents)),
    o as (select l.*, g.k, row_number() over (partition by g.k order by doc_id nulls first, leaf) - 1 as i
          from l join g on l.source is not distinct from g.source),
    b as (select k, i, leaf as h from o),
    {_tree_sql("t", "b")},
    s as (select 0 as k, k - 1 as i, h from t6),
    {_tree_sql("u", "s")},
    start as (select doc_id, leaf, k, i as spot, other as folded, '' as proof from o),
    {_walk_sql("v", "t", "start")},
    middle as (select v5.* exclude (k, spot), t6.h as subroot, 0 as k, v5.k - 1 as spot from v5 join t6 using (k)),
    {_walk_sql("w", "u", "middle")}
    select doc_id, leaf, subroot, u6.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = u6.h as verified
    from w5, u6""")
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = merkle.tampered(read(spark, sf_dir, "documents"), "tampered_text")
    found = merkle.manifest(docs, altered={"text": F.col("tampered_text")})
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
                        merkle.folded(F.col("altered_leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _repair_sql() -> str:
    """Rows one after another; each state holds its cheapest edits, of those the least, and the text they leave."""
    kind = "struct(c bigint, a varchar, o varchar)"
    states = ("none", "sys", "usr", "ast")

    def edit(state: str, cost: str, letter: str, line: str | None) -> str:
        text = f"{state}.o" if line is None else f"{state}.o || chr(10) || {line}"
        return (f"case when {state} is null then null else {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', "
                f"'o': {text}}} end")

    def best(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x is not null))[1]"

    def inserts(source: str) -> str:
        one = f"""(select * replace ({best("usr", *[edit(s, "3", "I", "'user:'") for s in ("none", "sys", "ast")])} as usr) from {source})"""
        return f"""(select * replace ({best("ast", edit("usr", "3", "I", "'assistant:'"))} as ast) from {one})"""

    def kept(state: str, initial: str) -> str:
        return f"case when ini = '{initial}' and not gone then {edit(state, 'cut', 'K', 'role || chr(58) || text')} end"

    def reroled(state: str, role: str) -> str:
        return f"case when not gone then {edit(state, '3 + cut', 'R', repr(role + ':') + ' || text')} end"

    deleted = {s: edit(s, "4", "D", None) for s in states}
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    with recursive k as (select *, {_CRC.format("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind
               from conversations),
    d as (select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
                 case kind when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text,
                 unnest(case when kind = 3 then [0, 1] else [0] end) as copy
          from k where kind <> 0),
    p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i,
                 rtrim(text, {blank}) as bare, substr(role, 1, 1) as ini from d),
    q as (select *, bare = '' as blank, lag(ini) over (partition by conv_id order by i) || ini as pair,
                 bare <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as duplicate from p),
    r as (select *, blank or duplicate as gone,
                 not blank and not duplicate and right(bare, 1) not in ('.', '!', '?') as truncated from q),
    f as (select conv_id, i, role, text, ini, gone, case when truncated then 3 else 0 end as cut from r),
    w as (select conv_id, 0 as i, {{'c': 0, 'a': '', 'o': ''}}::{kind} as none, null::{kind} as sys, null::{kind} as usr,
                 null::{kind} as ast from (select distinct conv_id from f)
          union all
          select conv_id, i + 1, {best(deleted["none"])}, {best(deleted["sys"], kept("none", "s"))},
                 {best(deleted["usr"], kept("none", "u"), kept("sys", "u"), kept("ast", "u"), reroled("none", "user"),
                       reroled("sys", "user"), reroled("ast", "user"))},
                 {best(deleted["ast"], kept("usr", "a"), reroled("usr", "assistant"))}
          from {inserts("(select w.*, f.* exclude (conv_id, i) from w join f on w.conv_id is not distinct from f.conv_id and w.i = f.i)")}),
    z as (select conv_id, {best("none", "ast")} as won from {inserts(
          "(select * from w qualify row_number() over (partition by conv_id order by i desc) = 1)")}),
    n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                 count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
                 count(*) filter (where truncated) as truncated,
                 count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
    select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
           coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(won.c, 0) as cost,
           coalesce(won.a, '') as audit, sha256(substr(coalesce(won.o, ''), 2)) as repaired_sha256
    from (select distinct conv_id from conversations) o left join n on o.conv_id is not distinct from n.conv_id
    left join z on o.conv_id is not distinct from z.conv_id"""


@query("op13_conversations", _repair_sql())
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return conversations.repair_report(conversations.damaged(rows), rows)


@query("op12_embeddings", f"""
    with recursive v as (select row_number() over () as r, vec_id, cast(embedding as double[]) as e from embeddings),
    ok as (select r, e from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
           and len(list_filter(e, lambda x: x <> 0)) > 0),
    l as (select a.r as u, b.r as w from ok a join ok b on a.r <> b.r where case when len(a.e) = len(b.e)
          then list_cosine_similarity(a.e, b.e) >= {embeddings.THRESHOLD} else false end),
    n as (select u as r, count(*) as n_links from l group by u),
    c as (select r, r as w from v union select c.r, l.w from c join l on c.w = l.u),
    s as (select c.r, min(v.vec_id) as component_id from c join v on c.w = v.r group by c.r)
    select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
    from v join s using (r) left join n using (r)""")
def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.selectExpr("id as vec_id", "links as n_links", "component as component_id", "kept")
