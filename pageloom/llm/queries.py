"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import chaining, chat, decontam, edit_tokens, imatch, jaccard, knn_quality, mixing, ppm, url_filter
from pageloom.llm.common import table


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all pages. A page's number is that of the document it shows, so the documents' labels are its own."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("url_key")).agg(F.min(good).alias("good"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), labels)


def op2_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score_texts(table(spark, sf_dir, "documents"), learn=~ppm.held_out())
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_chat_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_chats(rows.unionAll(own))).drop("n_tokens", "n_loss_tokens")


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), mixing.quality_domains(table(spark, sf_dir, "labels")))


def op5_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeats_by_document(table(spark, sf_dir, "documents"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op7_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: a replacement near the middle, a cut in the first third, an addition at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    change = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), F.lit(new).alias("new"))
    half, third = F.floor(n / 2), F.floor(n / 3)
    edits = F.array(change(half, half + 24, " an edited passage, 2 "), change(third, third + 40, ""), change(n, n, "\nadded at the end"))
    return edit_tokens.count_with_edits(docs.withColumn("edits", edits))


def op10_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_templates, op2_ppm_scoring, op3_chat_assembly, op4_soft_mixing, op5_collinear_chains, op6_imatch, op7_knn_quality, op8_prefix_decontamination, op9_edit_token_counts, op10_bayes_jaccard]
    return {f.__name__: f for f in own}


_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text,''),{_ALPHABET}),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _escaped(column: str) -> str:
    out = f"replace({column}, '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
    for mark in sorted(chat.CONTROLS, key=len, reverse=True):
        out = f"replace({out}, '{mark}', '{mark[0]}{chat.ESCAPE}{mark[1:]}')"
    return out


def _chat_sql() -> str:
    said = "</s>[INST] ok [/INST]"
    marks = " ".join(f"when '{role}' then {len(head) + len(tail)}" for role, (head, tail) in chat.MARKS.items())
    other = sum(map(len, chat.OTHER))
    return f"""with r as (select conv_id, turn, coalesce(role,'') role, coalesce(text,'') text from conversations union all select * from (values (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}')) v(a, b, c, d))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
sum(length({_escaped("text")}) + case role {marks} else {other} + length({_escaped("role")}) end)::bigint as formatted_chars from r group by conv_id"""


def _decontamination_sql() -> str:
    n = decontam.WINDOW
    return f"""with i as (select item_id, {_WORDS} ws from benchmark), iw as (select item_id, unnest(list_transform(range(1, greatest(1, len(ws) - {n - 1}) + 1), lambda k: ws[k:k + {n - 1}])) w from i where len(ws) > 0),
win as (select distinct item_id, len(w) n, array_to_string(w, ' ') s from iw), d as (select doc_id, {_WORDS} ws from documents), sizes as (select distinct n from win),
dw as (select doc_id, n, unnest(range(1, len(ws) - n + 2)) k, ws from d, sizes where len(ws) >= n), ds as (select doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') s from dw),
h as (select ds.doc_id, ds.k, ds.n, win.item_id from ds join win on ds.n = win.n and ds.s = win.s), p as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(k, k + n)) q from h) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from h) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join p on d.doc_id = p.doc_id left join it on d.doc_id = it.doc_id"""


def _imatch_sql() -> str:
    terms = lambda c: rf"list_filter(list_distinct(string_split_regex(lower({c}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')), lambda x: x <> '')"
    components = ", ".join(f"coalesce(left(md5(string_agg(l.term, ' ' order by l.term) filter (where substr(l.digest, {2 * n + 1}, 2) < '{imatch.KEEP}')), 8), '')" for n in range(imatch.LEXICONS))
    empty = "." * (imatch.LEXICONS - 1)
    like = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: (p[1] <> '' and p[1] = p[2])::int))::double / list_sum(list_transform(list_zip({x}, {y}), lambda p: (p[1] <> '' or p[2] <> '')::int))"
    return f"""with d as (select doc_id, coalesce(text,'') text from documents), e as (select doc_id, text, coalesce(lead(text) over w, first(text) over (order by doc_id desc rows between unbounded preceding and unbounded following)) nxt, coalesce(lead(doc_id) over w, first(doc_id) over (order by doc_id desc rows between unbounded preceding and unbounded following)) nid from d window w as (order by doc_id desc)),
x as (select doc_id, nid, text, left(text, length(text) - length(text) // 3) || left(nxt, length(text) // 3) edited from e), f as (select term, count(*) df from (select unnest({terms("text")}) term from d) group by term),
l as (select term, md5(term) digest from f, (select count(*) n from d) c where df >= {imatch.LOW} * n and df <= {imatch.HIGH} * n),
t as (select doc_id, 0 k, text s from x union all select doc_id, 1, edited from x), tt as (select doc_id, k, unnest({terms("s")}) term from t),
g as (select t.doc_id, t.k, any_value(t.s) s, concat_ws('.', {components}) p from t left join tt on t.doc_id = tt.doc_id and t.k = tt.k left join l on tt.term = l.term group by t.doc_id, t.k),
fp as (select doc_id, k, case when p = '{empty}' then md5(s) || p else p end p from g)
select x.doc_id, length(x.text)::bigint as n_chars, sha256(x.edited) as edited_sha256, a.p as fingerprint, b.p as edited_fingerprint, {like("string_split(a.p, '.')", "string_split(b.p, '.')")} as near_edited, {like("string_split(a.p, '.')", "string_split(c.p, '.')")} as near_next
from x join fp a on a.doc_id = x.doc_id and a.k = 0 join fp b on b.doc_id = x.doc_id and b.k = 1 join fp c on c.doc_id = x.nid and c.k = 0"""


def _jaccard_sql() -> str:
    k = jaccard.SHINGLE
    return f"""with recursive d as (select doc_id, coalesce(text,'') text, {_WORDS} ws from documents),
s as (select doc_id, case when len(ws) >= {k} then list_sort(list_distinct(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')))) when len(ws) > 0 then ['short ' || array_to_string(ws, ' ')] else [] end sh, case when len(ws) = 0 then text else '' end raw from d),
n as (select sh, raw, min(doc_id) node, count(*) copies from s group by sh, raw), u as (select node, len(sh) size, unnest(sh) g from n where len(sh) > 0),
p as (select a.node a, b.node b, count(*) common, any_value(a.size) x, any_value(b.size) y from u a join u b on a.g = b.g and a.node <> b.node group by a.node, b.node), e as (select a, b from p where common >= {jaccard.THRESHOLD} * (x + y - common)),
r as (select node a, node b from n union select r.a, e.b from r join e on r.b = e.a), c as (select a, min(b) class_id from r group by a), l as (select e.a, count(*) texts, sum(m.copies) docs from e join n m on m.node = e.b group by e.a)
select s.doc_id, c.class_id, (coalesce(l.docs, 0) + n.copies - 1)::bigint as n_links, coalesce(l.texts, 0)::bigint as n_text_links, n.copies as n_copies from s join n on n.sh = s.sh and n.raw = s.raw join c on c.a = n.node left join l on l.a = n.node"""


def _url_sql() -> str:
    u = url_filter
    ordered = sorted(u.RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda rule: f"((host = '{rule[: rule.index('/')]}' or ends_with(host, '.{rule[: rule.index('/')]}')) and starts_with(path, '{rule[rule.index('/') :]}'))"
    rule = "case " + " ".join(f"when {fits(r)} then '{r}'" for _, r in ordered) + " end"
    says = "case " + " ".join(f"when {fits(r)} then '{v}'" for v, r in ordered) + " end"
    s, t = [f"s{n}" for n in range(u.DEPTH + 1)], [f"t{n}" for n in range(u.DEPTH + 1)]
    parts = "string_split(regexp_replace(regexp_replace(path,'^/',''),'[0-9]+','*','g'),'/')"
    shapes = ", ".join([*(f"case when len({parts}) >= {n + 1} then {parts}[{n + 1}] end {s[n]}" for n in range(u.DEPTH)), f"case when len({parts}) > {u.DEPTH} then '**' end {s[-1]}"])
    sql = f"""with p0 as (select page_id, case when strpos(url,'://') > 0 then substr(url, strpos(url,'://') + 3) else '' end rest from pages),
p1 as (select page_id, translate(regexp_extract(rest,'^([^/?#]*)',1),{_ALPHABET}) host, regexp_extract(rest,'^[^/?#]*([^?#]*)',1) path from p0),
p2 as (select *, {rule} rule, {says} says, {shapes}, try_cast(nullif(regexp_extract(path,'([0-9]+)',1),'') as bigint) k from p1),
lab as (select doc_id, min((quality = 1 and toxic = 0)::int) good from labels group by doc_id), x0 as (select p2.*, good from p2 left join lab on k = doc_id)"""
    for n in range(u.DEPTH):
        above = ", ".join(["host", *t[:n], s[n]])
        sql += f",\nx{n + 1} as (select *, case when count(*) over (partition by {above}) >= {u.SUPPORT} then {s[n]} when {s[n]} is not null then '*' end {t[n]} from x{n})"
    levels = ["host", *t]
    sql += f",\ntree as (select *, {s[-1]} {t[-1]} from x{u.DEPTH}), leaf as (select {', '.join(levels)}, count(good) l, coalesce(sum(good), 0) g from tree group by all), top as (select (coalesce(sum(g), 0) + 1)::double / (coalesce(sum(l), 0) + 1) q from leaf)"
    for n in range(1, len(levels) + 1):
        key, up = levels[:n], levels[: n - 1]
        same = " and ".join(f"a.{c} is not distinct from b.{c}" for c in up) or "true"
        before = "top" if n == 1 else f"q{n - 1}"
        over = f"partition by {', '.join(up)}" if up else ""
        sql += f""",\na{n} as (select a.*, b.q q_up from (select {", ".join(key)}, sum(l)::double l, sum(g)::double g from leaf group by all) a join {before} b on {same}),
o{n} as (select *, l >= {u.LEAST_LABELS} and pow(g - l * q_up, 2) > {u.Z2} * greatest(l * q_up * (1 - q_up), 1e-9) own from a{n}),
q{n} as (select *, (case when own then g else sum(g) filter (where not own) over ({over}) end + {u.PRIOR} * q_up) / (case when own then l else sum(l) filter (where not own) over ({over}) end + {u.PRIOR}) q from o{n})"""
    same = " and ".join(f"tree.{c} is not distinct from z.{c}" for c in levels)
    return f"""{sql}
select page_id, tree.host, path, rule, coalesce(says, case when q < {u.THRESHOLD} then 'block' else 'allow' end) as verdict, tree.host || '/' || concat_ws('/', {", ".join("tree." + c for c in t)}) as template, l::bigint as n_labelled, round(q, 6) as purity
from tree join q{len(levels)} z on {same}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_templates": _url_sql(),
        "op3_chat_assembly": _chat_sql(),
        "op6_imatch": _imatch_sql(),
        "op8_prefix_decontamination": _decontamination_sql(),
        "op10_bayes_jaccard": _jaccard_sql(),
    }
