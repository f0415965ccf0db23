"""Registered queries over texts, vectors, papers and streams, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import cuts
from graphloom.functions import text as T
from graphloom.functions.shared import shared_dir, written
from graphloom.operators import knn, metrics, ranking, similarity
from graphloom.plans.graph_queries import graph
from graphloom.plans.tables import table, with_tables
from graphloom.sources import files
from graphloom.streaming import jobs

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_tables(sql)
        return f

    return keep


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("b1_slug", "select page_id, regexp_replace(lower(regexp_replace(replace(url, 'https://', ''), '[.][^.]*$', '')), '[ .]', '_', 'g') as slug from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.slug(F.replace("url", F.lit("https://"), F.lit(""))).alias("slug"))


@query("b2_preprocess", r"select page_id, length(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'gis')) as n from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.length(T.preprocess(F.col("html"))).cast("bigint").alias("n"))


WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"


@query("b3_slices", f"""with w as (select id, {WORDS} as w from chunks), p as (select id, w, unnest(range(0, cast(ceil(len(w) / 200.0) as bigint))) as part from w where len(w) > 0)
  select id, part, part * 200 as token_start, least(part * 200 + 200, len(w)) as token_end, md5(array_to_string(w[part * 200 + 1 : part * 200 + 200], ' ')) as h from p""")
def _(s, d):
    return T.slices(table(s, d, "chunks"), 200).select("id", F.col("part").cast("bigint").alias("part"), F.col("token_start").cast("bigint").alias("token_start"), F.col("token_end").cast("bigint").alias("token_end"), F.md5("text").alias("h"))


MOST, SHIFT = 200, 40
NEXT = f"case when n - a <= {MOST} then n else list_min([(kinds[k] * 1000 + abs(k - a - {MOST})) * 1000000000 + k for k in range(a + {MOST - SHIFT}, least(a + {MOST + SHIFT}, n - 1) + 1)]) % 1000000000 end"


@query("b3_soft_slices", rf"""with recursive t as (select id, regexp_extract_all(text, '{T.PIECE}') as w from chunks),
  p as (select id, len(w) as n, [case when regexp_matches(w[k + 1], '^\s*\n\s*#') then 1 when regexp_matches(w[k + 1], '^\s*\n\s*\n') then 2 when regexp_matches(w[k + 1], '^\s') and regexp_matches(w[k], '[.!?]$') then 3
    when regexp_matches(w[k + 1], '^\s') and regexp_matches(w[k], '[,;:]$') then 4 when regexp_matches(w[k + 1], '^\s') then 5 else 6 end for k in range(1, len(w))] as kinds from t where len(w) > 0),
  r(id, part, a, b) as (select id, 0::bigint, 0::bigint, {NEXT} from (select *, 0::bigint as a from p)
    union all select id, part + 1, a, {NEXT} from (select p.*, r.part, r.b as a from r join p using (id) where r.b < n))
  select id, part, a as token_start, b::bigint as token_end, md5(array_to_string(w[a + 1 : b], '')) as h from r join t using (id)""")
def _(s, d):
    return T.soft_slices(table(s, d, "chunks"), MOST, SHIFT).select("id", F.col("part").cast("bigint").alias("part"), F.col("token_start").cast("bigint").alias("token_start"), F.col("token_end").cast("bigint").alias("token_end"), F.md5("text").alias("h"))


@query("b4_numbered", f"""with w as (select id, slug, {WORDS} as w from chunks), p as (select id, slug, unnest(range(0, cast(ceil(len(w) / 200.0) as bigint))) as part from w where len(w) > 0)
  select id, part, row_number() over (order by id, part) - 1 as order_no from p""")
def _(s, d):
    parts = T.slices(table(s, d, "chunks"), 200)
    return T.numbered(parts, "id", "part").select("id", F.col("part").cast("bigint").alias("part"), F.col("order_no").cast("bigint").alias("order_no"))


@query("b5_soft_boundary")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.soft_boundary(F.coalesce("text", F.lit("")), (F.length("text") / 2).cast("int"), 60).cast("bigint").alias("at"))


END = r"(\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"


def odd_sql(x: str, mark: str, n: int) -> str:
    return f"((length({x}) - length(replace({x}, '{mark}', ''))) // {n}) % 2 = 1"


#: T.safe_cut of the texts b and a; Java's $ also matches before a last line end.
SAFE = rf"""not (regexp_matches(b, '[\p{{L}}\p{{N}}]{END}') and regexp_matches(a, '^[\p{{L}}\p{{N}}]') or regexp_matches(b, 'https?://\S*{END}') and regexp_matches(a, '^\S')
    or regexp_matches(b, '\[[^\]]*$') or regexp_matches(b, '\]\([^)]*$') or regexp_matches(b, '<[^<>]*$') and regexp_matches(a, '^[^<>]*>')
    or {odd_sql("b", "```", 3)} or {odd_sql("string_split(b, chr(10))[-1]", "`", 1)} or {odd_sql("b", "$$", 2)} or regexp_matches(b, '\n\|[^\n]*$') and not regexp_matches(b, '\n{END}'))"""


def safe_sql(at: str) -> str:
    """SQL of T.safe_cut for whole texts cut after ``at`` characters."""
    return f"with t as (select doc_id, left(text, {at}) as b, substring(text, {at} + 1) as a from documents) select doc_id, {SAFE} as safe from t"


@query("b6_b8_fallback_cut", rf"""with d as (select doc_id, text, length(text) // 2 as target from documents),
  s as (select k, case when k % 2 = 1 then (k + 1) // 2 * 10 else k // 2 * -10 end as step from (select unnest(range(13)) as k)),
  c as (select doc_id, k, target + step as cut, left(text, target + step) as b, substring(text, target + step + 1) as a from d cross join s where target + step > 0 and target + step < length(text)),
  g as (select doc_id, arg_min(cut, k) as cut from (select *, {SAFE} as safe from c) where safe group by doc_id),
  r as (select d.doc_id, coalesce(cut, target) as cut, left(text, coalesce(cut, target)) as b, substring(text, coalesce(cut, target) + 1) as a from d left join g using (doc_id)),
  q as (select *, {SAFE} as safe from r)
  select doc_id, cut as "at", safe, case when not safe then 0.0::double when regexp_matches(b, '\n\s*\n\s*$') or regexp_matches(a, '^#{{1,6}} ') then 1.0 when regexp_matches(b, '[.!?]\s*$') then 0.8 when regexp_matches(b, '[,;:]\s*$') then 0.5 else 0.2 end as quality from q""")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", T.fallback_cut(F.col("text"), (F.length("text") / 2).cast("int"), 200).alias("at"))
    before, after = F.substring(F.col("text"), F.lit(1), F.col("at")), F.substring(F.col("text"), F.col("at") + 1, F.length("text"))
    return docs.select("doc_id", F.col("at").cast("bigint").alias("at"), T.safe_cut(before, after).alias("safe"), T.cut_quality(before, after).alias("quality"))


@query("b7_safe_cut", safe_sql("200"))
def _(s, d):
    after = F.substring(F.col("text"), F.lit(201), F.length("text"))
    return table(s, d, "documents").select("doc_id", T.safe_cut(F.substring("text", 1, 200), after).alias("safe"))


@query("b7_safe_cut_whole", safe_sql("(length(text) // 2)"))
def _(s, d):
    half = F.floor(F.length("text") / 2).cast("int")
    before, after = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    return table(s, d, "documents").select("doc_id", T.safe_cut(before, after).alias("safe"))


#: A list item's and a table row's beginning.
ITEM, ROW = r"^(  |\t)?(\d+\.|[-*+])\s|^(  |\t)[a-z]\.\s|^(  )?•\s", r"^\s*\|.*\|"


@query("b7_safe_positions", rf"""with d as (select doc_id, coalesce(text, '') as text from documents),
  x as (select doc_id, unnest(regexp_extract_all(text, '(?s).')) as ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) as i from d),
  k as (select *, string_agg(ch, '') over (partition by doc_id order by i rows between 9 preceding and current row) as tail, lead(ch) over (partition by doc_id order by i) as nxt from x),
  c as (select *, sum(case ch when '[' then 1 when ']' then -1 else 0 end) over w as square, sum(case ch when '(' then 1 when ')' then -1 else 0 end) over w as round, max(case when ch = '<' then i else 0 end) over w as lt,
      max(case when ch = '>' then i else 0 end) over w as gt, sum((ch = '$')::int) over w % 2 as dollars, sum((ch = '`')::int) over w % 2 as ticks, sum((ch = chr(10))::int) over w as ln,
      max(case when regexp_matches(ch, '[\s)>\]]') then i else 0 end) over w as stop, max(case when ends_with(tail, 'http://') or ends_with(tail, 'https://') then i else 0 end) over w as addr,
      sum(ends_with(tail, '<table')::int) over w as tables, sum(ends_with(tail, '</table>')::int) over w as ends from k window w as (partition by doc_id order by i rows between unbounded preceding and current row)),
  t as (select *, coalesce(lag(tables, 195) over w, 0) as tables0, coalesce(lag(ends, 193) over w, 0) as ends0 from c window w as (partition by doc_id order by i)),
  l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ln from d),
  m as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by ln rows between unbounded preceding and 1 preceding), 0) as start,
      coalesce(max(regexp_matches(line, '{ITEM}')::int) over (partition by doc_id order by ln rows between 2 preceding and 1 preceding), 0) = 1 as items, coalesce(max(regexp_matches(line, '{ROW}')::int) over (partition by doc_id order by ln rows between 4 preceding and 1 preceding), 0) = 1 as above,
      coalesce(max(regexp_matches(line, '{ROW}')::int) over (partition by doc_id order by ln rows between 1 following and 4 following), 0) = 1 as below from l),
  j as (select t.*, items, above, below, left(line, (i - start)::bigint) as own, substring(line, (i - start)::bigint + 1) as rest from t join m on t.doc_id = m.doc_id and t.ln = m.ln where nxt is not null),
  s as (select doc_id, i from j where not (regexp_matches(ch, '[\p{{L}}\p{{N}}]') and regexp_matches(nxt, '[\p{{L}}\p{{N}}]') or addr > stop and not regexp_matches(nxt, '[\s)>\]]')
      or square > 0 or ch = ']' and nxt = '(' or contains(tail, '](h') or ends_with(tail, '](') and round > 0 or lt > gt or dollars = 1 or ticks = 1
      or (items or regexp_matches(own, '{ITEM}')) and regexp_matches(rest, '{ITEM}') or (above or regexp_matches(own, '{ROW}')) and (below or regexp_matches(rest, '{ROW}')) or tables - tables0 > ends - ends0))
  select doc_id, length(text) + 1 as n_cuts, (case when text = '' then 1 else 2 end) + count(i) as n_safe, (length(text) + coalesce(sum(i), 0))::bigint as places from d left join s using (doc_id) group by doc_id, text""")
def _(s, d):
    return cuts.safe_cuts(table(s, d, "documents"), "doc_id")


@query("b3_safe_slices")
def _(s, d):
    return cuts.safe_slices(table(s, d, "documents"), MOST, SHIFT, "doc_id").select("doc_id", "part", "token_start", "token_end", "reason", "safe", F.md5("text").alias("h"))


@query("b9_cleaned_reply", "select conv_id, turn, trim(text, chr(10) || chr(9) || chr(13) || ' ') as text from conversations")
def _(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", T.cleaned_reply(F.concat(F.lit("```json\n"), F.trim("text"), F.lit("\n```"))).alias("text"))


def abstracts(rows, key, text):
    """Abstracts from the inverted indexes of whole texts."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    index = rows.select(key, F.posexplode(words).alias("p", "w")).groupBy(key, "w").agg(F.collect_list("p").alias("ps")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select(key, T.abstract(F.col("index")).alias("abstract"))


@query("b10_abstract", "with w as (select page_id, regexp_extract_all(lower(html), '[a-z]+') as w from pages) select page_id, array_to_string(w, ' ') as abstract from w where len(w) > 0")
def _(s, d):
    return abstracts(table(s, d, "pages"), "page_id", "html")


@query("b10_abstract_whole", "with w as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents) select doc_id, array_to_string(w, ' ') as abstract from w where len(w) > 0")
def _(s, d):
    return abstracts(table(s, d, "documents"), "doc_id", "text")


@query("b11_tokenize", f"select doc_id, array_to_string([w for w in regexp_extract_all(lower(text), '[a-z0-9]+') if length(w) > 2 and w not in ({STOP})], ' ') as tokens from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


def spans_sql(source: str, key: str, text: str, markers: list[str], most: int, name: str) -> str:
    """SQL of T.evidence_spans as common tables ending in ``name``; between two pieces of a text split at a marker lies a hit."""
    listed = ", ".join(f"({k}, '{m}')" for k, m in enumerate(markers))
    return rf"""{name}_m as (select * from (values {listed}) as t(k, marker)), {name}_d as (select {key}, {text} as text, k, marker, string_split(lower({text}), marker) as ps from {source} cross join {name}_m),
  {name}_u as (select {key}, k, marker, unnest(ps) as piece, generate_subscripts(ps, 1) as j, len(ps) as n from {name}_d),
  {name}_o as (select *, sum(length(piece)) over w + (j - 1) * length(marker) as start, lead(piece) over (partition by {key}, k order by j) as nxt from {name}_u window w as (partition by {key}, k order by j rows between unbounded preceding and current row)),
  {name}_s as (select *, case when piece <> '' then right(piece, 1) when j = 1 then '' else right(marker, 1) end as b, left(nxt || case when j + 1 < n then marker else '' end, 2) as a from {name}_o where j < n),
  {name}_f as (select {key}, k, marker, start, start + length(marker) + case when regexp_matches(a, '^[0-9a-z]') then 1 else 0 end as stop from {name}_s
    where not regexp_matches(b, '[0-9a-z]') and (not regexp_matches(a, '^[0-9a-z]') or regexp_matches(a, '^s([^0-9a-z]|$)') and not contains(marker, ' ') and not ends_with(marker, 's'))),
  {name} as (select {key}, marker, start::bigint as start, stop::bigint as "end" from {name}_f qualify row_number() over (partition by {key} order by k, start) <= {most})"""


@query("b12_evidence_spans", f"""with {spans_sql("documents", "doc_id", "text", ["the", "token", "que", "der"], 8, "s")}
  select s.*, trim(substring(text, greatest(start - 70, 0) + 1, "end" - greatest(start - 70, 0) + 70), ' ' || chr(10) || chr(9) || chr(13)) as excerpt from s join documents using (doc_id)""")
def _(s, d):
    return T.evidence_spans(table(s, d, "documents"), ["the", "token", "que", "der"], "doc_id").select("doc_id", "marker", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "excerpt")


@query("b13_collected_spans", f"""with {spans_sql("papers", "paper_id", "title", ["the", "token", "que"], 4, "t")}, {spans_sql("papers", "paper_id", "abstract", ["the", "token", "que"], 8, "a")},
  u as (select paper_id, 0 as n, 'title' as field, marker, start from t union all select paper_id, 1, 'body', marker, start from a)
  select paper_id, field, marker, start, row_number() over (partition by paper_id order by n, start, marker) as rank from u qualify rank <= 14""")
def _(s, d):
    papers = table(s, d, "papers")
    fields = {"title": (papers.select("paper_id", F.col("title").alias("text")), 4), "body": (papers.select("paper_id", F.col("abstract").alias("text")), 8)}
    return T.collected_spans(fields, ["the", "token", "que"], "paper_id").select("paper_id", "field", "marker", F.col("start").cast("bigint").alias("start"), "rank")


@query("b14_sections", "select doc_id, 'methodology' as section, trim(replace(text, chr(10), ' ')) as body from documents where trim(replace(text, chr(10), ' ')) <> ''")
def _(s, d):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("## 2. Methods:\n"), flat, F.lit("\n# Other\nrest")).alias("text"))
    return T.sections(docs, "doc_id")


@query("b15_jats_text")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.jats_text(F.col("html"))).alias("text_md5"))


@query("b16_identifiers", """select page_id, '10.1234/p' || page_id as doi, case when page_id % 2 = 0 then '2101.' || lpad(page_id::varchar, 5, '0') end as arxiv, (10000 + page_id)::varchar as pmid, 'PMC' || page_id as pmcid, 'W' || page_id as work from pages""")
def _(s, d):
    p = table(s, d, "pages")
    key = F.col("page_id").cast("string")
    return p.select(
        "page_id", T.doi(F.concat(F.lit("https://doi.org/10.1234/p"), key, F.lit(")."))).alias("doi"),
        T.arxiv_id(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/abs/2101."), F.lpad(key, 5, "0"))).otherwise(F.lit("https://example.org/abs/2101.00001"))).alias("arxiv"),
        T.pmid(F.concat(F.lit("PMID: "), (10000 + F.col("page_id")).cast("string"))).alias("pmid"), T.pmcid(F.concat(F.lit("pmc"), key)).alias("pmcid"), T.work_id(F.concat(F.lit("https://x.org/w"), key)).alias("work"),
    )


@query("b17_urls", "select page_id, url from pages")
def _(s, d):
    entry = lambda t, u: F.struct(F.lit(t).alias("type"), u.alias("url"))
    bag = F.array(entry("pdf", F.col("url")), entry("pdf", F.col("url")), entry("pdf", F.lit("ftp://x")), entry("html", F.lit(None).cast("string")))
    return table(s, d, "pages").select("page_id", F.explode(T.collected_urls(bag)["url"]).alias("url"))


@query("b18_title_match", "select page_id, 1.0::double as score from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.title_match(F.upper("url"), F.col("url")).alias("score"))


@query("b19_repaired", "select doc_id, text from documents where lang = 'en' and regexp_full_match(text, '[\\x00-\\x7F]*')")
def _(s, d):
    docs = table(s, d, "documents").where("lang = 'en'").where(F.col("text").rlike("^[\\x00-\\x7F]*$"))
    return docs.select("doc_id", T.repaired(F.col("text")).alias("text"))


@query("b20_markdown", "select doc_id, 'heading' as type, '# T' as content from documents union all select doc_id, 'paragraph', replace(text, chr(10), ' ') from documents where trim(replace(text, chr(10), ' ')) <> '' and not regexp_matches(replace(text, chr(10), ' '), '^(#{1,6} |\\s*\\||\\s*[-*+] |\\s*[0-9]+[.)] )')")
def _(s, d):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("# T\n"), F.when(flat.rlike(r"^(#{1,6} |\s*\||\s*[-*+] |\s*[0-9]+[.)] )"), F.lit("")).otherwise(flat)).alias("text"))
    return T.markdown_elements(docs, "doc_id").select("doc_id", "type", "content")


@query("b21_table_quality", "select page_id, page_id % 2 = 0 as low from pages")
def _(s, d):
    good = F.concat(F.lit("| a | b |\n|---|---|\n| "), F.col("page_id").cast("string"), F.lit(" | x |\n| 1 | 2 |"))
    return table(s, d, "pages").select("page_id", T.table_quality(F.when(F.col("page_id") % 2 == 0, F.lit("| a |  |\n|---|---|\n|  |  |")).otherwise(good)).alias("low"))


@query("b22_sheet_grid", """with b as (select 'f' || l_suppkey as file, l_suppkey % 7 as sheet, l_linenumber as row, max(l_partkey) as p from lineitem group by l_suppkey, l_linenumber),
  c as (select *, first_value(p) over (partition by file, sheet order by row) as top, min(row) over (partition by file, sheet) as head from b)
  select file, sheet, row, '| v' || p || ' | ' || case when row <= head + 1 then 'm' || top else 'w' end || ' |' as line from c""")
def _(s, d):
    base = table(s, d, "lineitem").groupBy(F.concat(F.lit("f"), "l_suppkey").alias("file"), (F.col("l_suppkey") % 7).alias("sheet"), F.col("l_linenumber").alias("row")).agg(F.max("l_partkey").alias("p"))
    head = base.groupBy("file", "sheet").agg(F.min("row").alias("r1"))
    # The second column's first cell spans the rows r1 and r1 + 1, where there are such.
    last = base.join(head, ["file", "sheet"]).where("row <= r1 + 1").groupBy("file", "sheet", "r1").agg(F.max("row").alias("r2"))
    merges = last.select("file", "sheet", "r1", F.lit(2).alias("c1"), "r2", F.lit(2).alias("c2"))
    first = F.when(F.col("row") == F.col("r1"), F.concat(F.lit("m"), "p")).otherwise("w")
    pair = F.array(F.struct(F.lit(1).alias("col"), F.concat(F.lit("v"), "p").alias("value")), F.struct(F.lit(2).alias("col"), first.alias("value")))
    cells = base.join(head, ["file", "sheet"]).select("file", "sheet", "row", F.explode(pair).alias("c")).select("file", "sheet", "row", "c.col", "c.value")
    return T.sheet_grid(cells, merges)


@query("b23_budgeted", """with x as (select source, doc_id, left(text, 8000) as t from documents), y as (select *, coalesce(sum(length(t)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as b from x)
  select source, doc_id, cast(length(left(t, cast(32000 - b as bigint))) as bigint) as n from y where b < 32000""")
def _(s, d):
    return T.budgeted(table(s, d, "documents").select("source", "doc_id", "text"), "source", "doc_id").select("source", "doc_id", F.length("text").cast("bigint").alias("n"))


@query("b24_truncated", "select doc_id, case when length(text) > 50 then left(text, 47) || '...' else text end as text, left(regexp_replace(regexp_replace(lower(left(text, 90)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) as slug from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.truncated(F.col("text"), 50).alias("text"), T.topic_slug(F.substring("text", 1, 90)).alias("slug"))


@query("b25_payload_text", "select doc_id, text from documents where trim(text) <> '' and trim(text) = text and not regexp_matches(text, '^[\\[{\"]')")
def _(s, d):
    docs = table(s, d, "documents").where("trim(text) <> '' and trim(text) = text").where(~F.col("text").rlike('^[\\[{"]'))
    payload = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.lit(" ").alias("content"), F.col("text").alias("markdown")))).when(F.col("doc_id") % 3 == 1, F.to_json(F.array("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", T.payload_text(payload).alias("text"))


# Papers


def papers_and_edges(s, d):
    p = table(s, d, "papers")
    return p, ranking.citation_edges(p, table(s, d, "citations"))


def scored_papers(s, d):
    p, edges = papers_and_edges(s, d)
    ranks = metrics.pagerank(p.select(F.col("paper_id").alias("id")), edges, rounds=60, tolerance=0, weighted=False).withColumnRenamed("id", "paper_id")
    return p, edges, ranking.signals(p, ranks, "the that and token", 2025)


def ranked_papers(s, d):
    p, edges, sig = scored_papers(s, d)
    return p, edges, ranking.ranked(ranking.combined(sig))


def cheap(s, d):
    """Signals that SQL can state: those without PageRank and markers."""
    p = table(s, d, "papers")
    out = p.select("paper_id", "title", "retracted", "citations", "year").join(ranking.impact(p), "paper_id").join(ranking.velocity(p, 2025), "paper_id")
    for c in ("topical", "prestige", "methodology", "reproducibility"):
        out = out.withColumn(c, F.lit(None).cast("double"))
    return p, out


CHEAP = """m as (select greatest(1.0e0, max(ln(1 + citations))) as mi, greatest(1.0e0, max(ln(1 + citations / greatest(1, 2025 - year + 1)))) as mv from papers),
 sig as (select papers.*, coalesce(percentile * 100, ln(1 + citations) / mi * 100) as impact, ln(1 + citations / greatest(1, 2025 - year + 1)) / mv * 100 as velocity from papers, m)"""


def cheap_scores(weights: dict) -> str:
    return " union all ".join(f"select '{p}' as profile, paper_id, title, citations, year, retracted, impact, velocity, floor(least((impact * {w[1]}e0 + velocity * {w[3]}e0) / ({w[1]}e0 + {w[3]}e0), case when retracted then 20.0e0 else 1000.0e0 end) * 100 + 0.5e0) / 100 as score from sig" for p, w in weights.items())


RANKED = f"{CHEAP}, sc as ({cheap_scores(ranking.PROFILES)}), rk as (select *, row_number() over (partition by profile order by score desc, title, paper_id) as rank from sc)"


@query("l1_works", "select 'W' || doc_id as id, source as label, least(1.0e0, doc_id / 150.0e0) as percentile from documents where doc_id % 7 <> 0")
def _(s, d):
    docs = table(s, d, "documents")
    works = docs.select(
        F.concat(F.lit("W"), "doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.lit("t")).alias("title"), (F.col("doc_id") / 150.0).alias("percentile"), F.lit(-1).alias("citations"),
        F.array(F.struct(F.col("source").alias("name"), F.lit(0.2).alias("score")), F.struct(F.lit("low").alias("name"), F.lit(0.1).alias("score"))).alias("labels"), F.array(F.lit(False), F.lit(True)).alias("open"),
    )
    return ranking.normalized_works(works).select("id", F.explode("labels").alias("label"), "percentile")


@query("l2_citation_edges", "select source, target from citations where target in (select paper_id from papers)")
def _(s, d):
    return papers_and_edges(s, d)[1]


@query("l3_neighbourhood", """with s as (select paper_id from papers where paper_id % 10 = 0), i as (select target, source, row_number() over (partition by target order by source) as k from (select distinct source, target from citations where target in (select * from s) and source not in (select * from s))),
  o as (select source, target, row_number() over (partition by source order by target) as k from (select distinct source, target from citations where source in (select * from s) and target not in (select * from s) and source <> target)),
  oo as (select target as paper_id, min(source) as f from o where k <= 10 group by 1 order by 1 limit 100), ii as (select source as paper_id, min(target) as f from i where k <= 100 group by 1)
  select paper_id, 'seed' as origin, cast(null as bigint) as expanded_from from s union all select paper_id, 'outgoing_reference', f from oo union all select paper_id, 'incoming_citation', f from ii where paper_id not in (select paper_id from oo)""")
def _(s, d):
    return ranking.neighbourhood(table(s, d, "papers").where("paper_id % 10 = 0"), table(s, d, "citations"))


@query("l4_degrees", "select paper_id, cast(sum(i) as bigint) as cited, cast(sum(o) as bigint) as cites from (select target as paper_id, 1 as i, 0 as o from citations union all select source, 0, 1 from citations) group by 1")
def _(s, d):
    return ranking.citation_degrees(table(s, d, "citations"))


TOPIC = ["and", "that", "token"]


@query("l5_topical", """with w as (select paper_id, source_rank, title, list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[a-z0-9]+')) as w from papers), n as (select count(*) as n from papers)
  select paper_id, round((0.65e0 * (list_contains(w, 'that')::int + list_contains(w, 'token')::int) / 2 + 0.25e0 * (1 - (source_rank - 1) / (n - 1)) + 0.1e0 * (contains(lower(title), 'that')::int + contains(lower(title), 'token')::int) / 2) * 100, 6) as topical from w, n""")
def _(s, d):
    return ranking.topical(table(s, d, "papers"), "the that and token").select("paper_id", F.round("topical", 6).alias("topical"))


@query("l6_impact", f"with {CHEAP} select paper_id, round(impact, 6) as impact from sig")
def _(s, d):
    return ranking.impact(table(s, d, "papers")).select("paper_id", F.round("impact", 6).alias("impact"))


@query("l7_prestige", "select paper_id, round((citations - least(0, (select min(citations) from papers))) * 100.0e0 / (select max(citations) from papers), 6) as prestige from papers")
def _(s, d):
    return ranking.prestige(table(s, d, "papers").select("paper_id", F.col("citations").cast("double").alias("pagerank"))).select("paper_id", F.round("prestige", 6).alias("prestige"))


@query("l8_velocity", f"with {CHEAP} select paper_id, round(velocity, 6) as velocity from sig")
def _(s, d):
    return ranking.velocity(table(s, d, "papers"), 2025).select("paper_id", F.round("velocity", 6).alias("velocity"))


def rubric_sql() -> str:
    """SQL of ranking.rubric where each document is the section that its id says."""
    names = ", ".join(f"'{n}'" for n in T.SECTIONS)
    tables, parts = [f"sec as (select doc_id as paper_id, [{names}][doc_id % 9 + 1] as section, text from documents)"], []
    for k, (item, (own, markers)) in enumerate(ranking.RUBRIC.items()):
        among = ", ".join(f"'{n}'" for n in own.split())
        tables.append(f"own{k} as (select * from sec where section in ({among}))")
        tables.append(spans_sql(f"own{k}", "paper_id", "text", markers, 4, f"h{k}"))
        parts.append(f"""select sec.paper_id, '{item}' as item, case when section not in ({among}) then 'not_evaluated' when n >= 2 then 'present' when n = 1 then 'partial' else 'missing' end as answer
  from sec left join (select paper_id, count(distinct marker) as n from h{k} group by 1) c using (paper_id)""")
    return f"with {', '.join(tables)} {' union all '.join(parts)}"


def answers(s, d):
    """The rubric's answers where each document is the section that its id says."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("body"))
    names = F.array(*map(F.lit, T.SECTIONS))
    return ranking.rubric(docs, docs.withColumn("section", F.get(names, (F.col("paper_id") % 9).cast("int"))))


@query("l9_rubric", rubric_sql())
def _(s, d):
    return answers(s, d)


TITLED = "pt as (select *, title || chr(10) || abstract as body from papers)"


@query("l10_methodology", f"""with {TITLED}, {spans_sql("pt", "paper_id", "body", ranking.METHOD_MARKERS, 100, "m")}, {spans_sql("pt", "paper_id", "body", ranking.UNCERTAINTY_MARKERS, 100, "u")},
  a as (select paper_id, count(distinct marker) as n from m group by 1), b as (select paper_id, count(distinct marker) as n from u group by 1)
  select paper_id, case when length(abstract) > 80 then least(100.0::double, 7 * coalesce(a.n, 0) + 6 * coalesce(b.n, 0) + 14) end as methodology from pt left join a using (paper_id) left join b using (paper_id)""")
def _(s, d):
    return ranking.methodology(table(s, d, "papers"))


@query("l11_reproducibility", f"""with {TITLED}, {spans_sql("pt", "paper_id", "body", ranking.REPRODUCIBILITY_MARKERS, 100, "m")},
  a as (select paper_id, count(distinct marker) as n, bool_or(marker in ('github', 'code', 'repository', 'open source')) as c from m group by 1)
  select paper_id, least(100.0::double, case when open_access then 30 else 0 end + case when c then 30 else 0 end + least(7 * coalesce(n, 0), 25)) as reproducibility from pt left join a using (paper_id)""")
def _(s, d):
    return ranking.reproducibility(table(s, d, "papers"))


@query("l12_combined", f"with {RANKED} select paper_id, score from sc where profile = 'balanced'")
def _(s, d):
    return ranking.combined(cheap(s, d)[1]).select("paper_id", "score")


@query("l13_ranked", f"with {RANKED} select paper_id, rank from rk where profile = 'balanced'")
def _(s, d):
    return ranking.ranked(ranking.combined(cheap(s, d)[1])).select("paper_id", "rank")


@query("l13_full_ranking")
def _(s, d):
    return ranked_papers(s, d)[2].select("paper_id", "rank", "score")


@query("l14_sensitivity", f"with {RANKED} select paper_id, min(rank) as best, max(rank) as worst, max(rank) - min(rank) as range, case when max(rank) = min(rank) then 'stable' when max(rank) - min(rank) <= 2 then 'sensitive' else 'volatile' end as stability from rk group by 1")
def _(s, d):
    return ranking.sensitivity(ranking.profile_ranks(cheap(s, d)[1])).select("paper_id", "best", "worst", "range", "stability")


def pairs_sql(by: str) -> str:
    return f"l as (select concat_ws(':', {by}) as list, doc_id from documents), pairs as (select a.doc_id as preferred, b.doc_id as over_id from l a join l b on a.list = b.list and a.doc_id < b.doc_id)"


RUNS, OWN_RUNS = "doc_id // 40", "source, doc_id // 40"


def ranked_lists(s, d, *by):
    """All documents in lists of at most 40, by columns and runs of ids: every row is in one list."""
    docs = table(s, d, "documents").select(F.concat_ws(":", *by, F.floor(F.col("doc_id") / 40).cast("string")).alias("source"), F.col("doc_id").alias("paper_id"))
    return docs.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("paper_id")) - 1)


def no_pairs(s):
    return s.createDataFrame([], "preferred bigint, over bigint")


def agreement_sql(by: str) -> str:
    return f"""with {RANKED}, {pairs_sql(by)}, j as (select x.profile, x.rank as rp, y.rank as ro from pairs join rk x on x.paper_id = preferred join rk y on y.paper_id = over_id and y.profile = x.profile),
  a as (select profile, count(*) filter (rp < ro) as satisfied, count(*) filter (rp > ro) as violated, count(*) filter (rp = ro) as tied, round(count(*) filter (rp < ro) / count(*), 4) as rate from j group by 1)
  select *, row_number() over (order by rate desc, satisfied desc, profile) as place from a"""


@query("l15_preference_pairs", f"with {pairs_sql(RUNS)} select preferred, over_id as over from pairs")
def _(s, d):
    return ranking.preference_pairs(no_pairs(s), ranked_lists(s, d), most=None)


@query("l16_agreement", agreement_sql(RUNS))
def _(s, d):
    return ranking.agreement(ranking.preference_pairs(no_pairs(s), ranked_lists(s, d), most=None), ranking.profile_ranks(cheap(s, d)[1]))


@query("l15_preference_pairs_whole", f"with {pairs_sql(OWN_RUNS)} select preferred, over_id as over from pairs")
def _(s, d):
    return ranking.preference_pairs(no_pairs(s), ranked_lists(s, d, "source"), most=None)


@query("l16_agreement_whole", agreement_sql(OWN_RUNS))
def _(s, d):
    return ranking.agreement(ranking.preference_pairs(no_pairs(s), ranked_lists(s, d, "source"), most=None), ranking.profile_ranks(cheap(s, d)[1]))


@query("l17_ledger", f"with {RANKED} select rank, paper_id, case when paper_id % 3 = 0 then 'failed' else 'not_checked' end as status from rk where profile = 'balanced' and rank <= 25")
def _(s, d):
    notes = table(s, d, "papers").where("paper_id % 3 = 0").select("paper_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("failed").alias("status")), F.struct(F.lit(1).alias("pos"), F.lit("reproduced").alias("status")))).alias("x")).select("paper_id", "x.*")
    return ranking.ledger(ranking.ranked(ranking.combined(cheap(s, d)[1])), notes)


@query("l18_field_clusters", f"with {RANKED} select field as label, count(*) as papers, round(avg(score), 4) as mean_score, cast(sum(sc.citations) as bigint) as citations, min(sc.year) as first_year, max(sc.year) as last_year from sc join papers using (paper_id) where profile = 'balanced' group by 1 order by 2 desc, 3 desc, 1 limit 12")
def _(s, d):
    p, sig = cheap(s, d)
    return ranking.field_clusters(ranking.combined(sig), p.select("paper_id", F.col("field").alias("label")))


@query("l19_roles", f"""with {CHEAP}, dg as (select paper_id, sum(i) as cited, sum(o) as cites from (select target as paper_id, 1 as i, 0 as o from citations union all select source, 0, 1 from citations) group by 1)
  select paper_id, coalesce(nullif(concat_ws(',', case when impact >= 70 then 'foundation' end, case when year >= 2023 or velocity >= 70 then 'frontier' end, case when cited > 0 and cites > 0 then 'bridge' end), ''), 'lead') as roles from sig left join dg using (paper_id)""")
def _(s, d):
    return ranking.roles(cheap(s, d)[1], ranking.citation_degrees(table(s, d, "citations")), 2025).select("paper_id", F.array_join("roles", ",").alias("roles"))


@query("l20_critiques")
def _(s, d):
    return ranking.critiques(ranked_papers(s, d)[2])


@query("l21_next_actions")
def _(s, d):
    _, sig = cheap(s, d)
    own = ranking.ranked(ranking.combined(sig))
    notes = table(s, d, "papers").where("paper_id % 3 = 0").select("paper_id", F.lit(0).alias("pos"), F.lit("failed").alias("status"))
    return ranking.next_actions(own, ranking.sensitivity(ranking.profile_ranks(sig)), ranking.ledger(own, notes))


@query("l22_strongest_signals", f"with {CHEAP} select paper_id, case when impact >= velocity then 'impact,velocity' else 'velocity,impact' end as signals from sig")
def _(s, d):
    return ranking.extreme_signals(cheap(s, d)[1])


@query("l23_worksheet_pairs")
def _(s, d):
    _, sig = cheap(s, d)
    return ranking.worksheet_pairs(ranking.ranked(ranking.combined(sig)), ranking.sensitivity(ranking.profile_ranks(sig)))


@query("l24_acceptance")
def _(s, d):
    return ranking.acceptance(ranking.critiques(ranking.ranked(ranking.combined(cheap(s, d)[1]))))


@query("l25_cross_checks", f"""with {RANKED}, b as (select * from rk where profile = 'balanced' and rank <= 2), st as (select paper_id, max(rank) - min(rank) as r from rk group by 1)
  select 'top_gap' as check, min_by(paper_id, rank) as paper_id, round(max(score) - min(score), 4) as value from b union all select * from (select 'unstable', paper_id, r::double from st order by r desc, paper_id limit 3)""")
def _(s, d):
    _, sig = cheap(s, d)
    return ranking.cross_checks(ranking.ranked(ranking.combined(sig)), ranking.sensitivity(ranking.profile_ranks(sig)))


@query("l26_explorer")
def _(s, d):
    deg = ranking.citation_degrees(table(s, d, "citations"))
    own = ranking.ranked(ranking.combined(cheap(s, d)[1]))
    return ranking.explorer(own, deg, ranking.roles(own, deg, 2025))


@query("l27_full_text", f"with {RANKED} select paper_id, case when paper_id % 5 = 0 then 'error' when paper_id % 2 = 0 then 'available' else 'missing' end as status, cast(case when paper_id % 2 = 0 then length(abstract) else 0 end as bigint) as chars from rk join (select paper_id, abstract from papers) p using (paper_id) where profile = 'balanced' and rank <= 10")
def _(s, d):
    p, sig = cheap(s, d)
    texts = p.select("paper_id", F.when(F.col("paper_id") % 2 == 0, F.col("abstract")).alias("full_text"), F.when(F.col("paper_id") % 5 == 0, "timeout").alias("error"))
    return ranking.with_full_text(ranking.ranked(ranking.combined(sig)), texts).withColumn("chars", F.col("chars").cast("bigint"))


@query("l28_access_plan", "select page_id as paper_id, case when page_id % 3 = 0 then 'pdf' else 'page' end as route, case when page_id % 3 = 0 then url || '.pdf' else url end as url, case when page_id % 3 = 0 then 'ready' when page_id % 3 = 1 then 'open_page' else 'restricted' end as status from pages")
def _(s, d):
    p = table(s, d, "pages")
    k = F.col("page_id") % 3
    routes = p.select(F.col("page_id").alias("paper_id"), F.lit(0).alias("pos"), F.lit("page").alias("route"), "url", (k == 1).alias("open"), F.lit(False).alias("fetchable")).unionByName(
        p.where(k == 0).select(F.col("page_id").alias("paper_id"), F.lit(1).alias("pos"), F.lit("pdf").alias("route"), F.concat("url", F.lit(".pdf")).alias("url"), F.lit(False).alias("open"), F.lit(True).alias("fetchable"))
    )
    return ranking.access_plan(routes)


@query("l29_resolved", "select 'id-' || doc_id as identifier, doc_id as paper_id from documents")
def _(s, d):
    docs = table(s, d, "documents")
    keys = docs.select(F.lit("doi").alias("kind"), F.concat(F.lit("ID-"), "doc_id").alias("key"), F.col("doc_id").alias("paper_id")).unionByName(docs.select(F.lit("arxiv").alias("kind"), F.concat(F.lit("ID-"), "doc_id").alias("key"), (F.col("doc_id") + 1).alias("paper_id")))
    return ranking.resolved(docs.select(F.concat(F.lit("id-"), "doc_id").alias("identifier")), keys)


@query("l30_evidence_packet")
def _(s, d):
    spans = T.evidence_spans(table(s, d, "papers").select("paper_id", F.col("abstract").alias("text")), ["the", "token"], "paper_id")
    return ranking.evidence_packet(spans).select("paper_id", F.size("items").alias("n"), F.element_at("items", 1).alias("first"))


@query("l31_manifest", "select conv_id as run_id, 'one_primary' as rule from (select conv_id, count(*) filter (turn % 3 = 1) as n from conversations group by 1) where n <> 1")
def _(s, d):
    c = table(s, d, "conversations")
    runs = c.groupBy(F.col("conv_id").alias("run_id")).agg(F.lit("w").alias("workflow"), F.lit("s").alias("slug"), F.lit("completed").alias("status"))
    return ranking.manifest_violations(runs, c.select(F.col("conv_id").alias("run_id"), (F.col("turn") % 3 == 1).alias("primary"), F.lit(False).alias("raw_text")))


@query("l32_run_id", "select doc_id, left(sha256(lang || chr(0) || source || chr(0) || doc_id), 16) as run_id from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", ranking.run_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("run_id"))


# Similarity


def vectors(s, d):
    return similarity.unit(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@query("d3_unit_vectors", "select vec_id as id, round(sqrt(list_sum([x::double * x::double for x in embedding])) , 4) > 0 as positive, 1.0::double as norm from embeddings")
def _(s, d):
    v = vectors(s, d)
    raw = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x) > 0).alias("positive"))
    return raw.join(v, "id").select("id", "positive", F.round(similarity.cosine("embedding", "embedding"), 6).alias("norm"))


@query("d4_nearest", """with u as (select vec_id as id, [x::double for x in embedding] as v from embeddings), n as (select id, [x / sqrt(list_sum([y * y for y in v])) for x in v] as v from u),
  p as (select a.id, b.id as other, round(list_inner_product(a.v, b.v), 9) as similarity from n a join n b on a.id % 20 = 0 and a.id <> b.id),
  r as (select *, row_number() over (partition by id order by similarity desc, other) as rank from p)
  select id, other, round(similarity, 6) as similarity, rank from r where rank <= 5""")
def _(s, d):
    v = vectors(s, d)
    return similarity.nearest(v.where("id % 20 = 0"), v, 5).select("id", "other", F.round("similarity", 6).alias("similarity"), "rank")


@query("d4_lsh_pairs", """with v as (select vec_id as id, [x::double for x in embedding] as v from embeddings), o as (select min(id) as id, v from v where list_sum([x * x for x in v]) > 0 group by v), u as (select id, [x / sqrt(list_sum([y * y for y in v])) for x in v] as u from o)
  select a.id as a, b.id as b from u a join u b on a.id < b.id where round(list_inner_product(a.u, b.u), 9) >= 0.6 union all select o.id, v.id from v join o using (v) where v.id <> o.id""")
def _(s, d):
    """All pairs of similarity 0.6 between classes of equal vectors, and each copy with its class; exact, where buckets of single projections met nearly all rows."""
    return similarity.similar_pairs(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.6).select("a", "b")


@query("d4_nearest_of_all")
def _(s, d):
    """Every row's five, by the inverted file, with the recall against the exact five of the ids divisible by 20."""
    found = knn.nearest_of_all(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 5)
    found = written(found, f"{shared_dir(s)}/found")
    v = vectors(s, d)
    share = knn.recall(found, similarity.nearest(v.where("id % 20 = 0"), v, 5))
    return found.join(F.broadcast(share)).select("id", "other", F.round("similarity", 6).alias("similarity"), "rank", F.round("recall", 4).alias("recall"))


@query("d4_recall", "select count(*) as n_vectors, 5 * count(*) as n_pairs, true as reached from embeddings")
def _(s, d):
    """One row: whether every row has its five, and whether at least 0.9 of the exact five of the ids divisible by 20 are among them."""
    v = vectors(s, d)
    found = written(knn.nearest_of_all(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 5), f"{shared_dir(s)}/found")
    share = knn.recall(found, similarity.nearest(v.where("id % 20 = 0"), v, 5))
    return found.agg(F.countDistinct("id").alias("n_vectors"), F.count("*").alias("n_pairs")).join(F.broadcast(share)).select("n_vectors", "n_pairs", (F.col("recall") >= 0.9).alias("reached"))


SHINGLES = """with w as (select pos as id, length(text) as chars, regexp_extract_all(lower(text), '[^\\s]+') as w from chunks), g as (select id, unnest([array_to_string(w[i + 1 : i + 3], ' ') for i in range(greatest(len(w) - 2, 1))]) as s from w where len(w) > 0),
  h as (select id, ('0x' || left(md5(s), 15))::bigint as h from g), b as (select id, b, sum((h >> b) & 1) * 2 - count(*) as x from h cross join (select unnest(range(60)) as b) group by all),
  u as (select id, list(x::double order by b) as v from b group by id), n as (select id, [x / greatest(sqrt(list_sum([y * y for y in v])), 1e-300) for x in v] as v from u),
  p as (select a.id, b.id as other, round(list_inner_product(a.v, b.v), 9) as similarity from n a join n b on a.id <> b.id),
  r as (select * from p where similarity >= 0.5 qualify row_number() over (partition by id order by similarity desc, other) <= 5),
  d as (select least(r.id, r.other) as master, greatest(r.id, r.other) as duplicate, round(max(similarity), 6) as similarity from r join w x on x.id = r.id join w y on y.id = r.other
    where similarity >= 0.85 and least(x.chars, y.chars) / greatest(x.chars, y.chars) >= 0.8 group by all)"""


def near_texts(s, d):
    """The neighbours of every chunk by the vectors of its shingles, and D5's pairs of them."""
    docs = table(s, d, "chunks").select(F.col("pos").alias("id"), F.col("pos").alias("position"), "text")
    near = knn.nearest_of_all(knn.shingle_vectors(docs), 5, least=0.85, target=0.99)
    return similarity.duplicate_pairs(near, docs, 0.85)


@query("d5_near_duplicates", SHINGLES + " select * from d")
def _(s, d):
    return near_texts(s, d).withColumn("similarity", F.round("similarity", 6))


@query("d6_near_duplicate_map", "with recursive " + SHINGLES[5:] + """, sym as (select master as a, duplicate as b from d union select duplicate, master from d), reach(a, b) as (select a, b from sym union select reach.a, sym.b from reach join sym on reach.b = sym.a),
  lab as (select a as id, least(a, min(b)) as label from reach group by a), never as (select label, min(id) as m from lab where id not in (select duplicate from d) group by label), low as (select label, min(id) as low from lab group by label)
  select id as duplicate, coalesce(m, low) as master from lab join low using (label) left join never using (label) where id <> coalesce(m, low)""")
def _(s, d):
    return similarity.duplicate_map(written(near_texts(s, d), f"{shared_dir(s)}/pairs"))


def text_duplicates(s, d):
    docs = table(s, d, "chunks")
    low = docs.groupBy("text").agg(F.min("pos").alias("p"), F.count("*").alias("n")).where("n > 1 and text <> ''")
    return docs.join(low, "text").where("pos > p").select(F.col("p").alias("master"), F.col("pos").alias("duplicate"), F.lit(1.0).alias("similarity"))


@query("d1_d2_candidates", "select id, pos as position from chunks where trim(coalesce(text, '')) <> ''")
def _(s, d):
    return similarity.positioned(similarity.candidates_for_dedup(table(s, d, "chunks"))).select("id", "position")


@query("d5_duplicate_pairs", "with l as (select min(pos) as m, text from chunks group by text having count(*) > 1) select m as master, pos as duplicate, 1.0::double as similarity from chunks join l using (text) where pos > m and text <> ''")
def _(s, d):
    docs = table(s, d, "chunks").select(F.col("pos").alias("id"), F.col("pos").alias("position"), "text")
    near = text_duplicates(s, d).select(F.col("duplicate").alias("id"), F.col("master").alias("other"), "similarity")
    return similarity.duplicate_pairs(near, docs)


@query("d6_duplicate_map", "with l as (select min(pos) as m, text from chunks group by text having count(*) > 1) select pos as duplicate, m as master from chunks join l using (text) where pos > m and text <> ''")
def _(s, d):
    return similarity.duplicate_map(text_duplicates(s, d))


@query("d7_rewritten", """with m as (select 'prp_' || n_nationkey as id, 'prp_' || (n_nationkey - 1) as master from nation where n_nationkey % 2 = 1), x as (select coalesce(a.master, e.source) as source, coalesce(b.master, e.target) as target, e.type, e.pos from edges e left join m a on a.id = e.source left join m b on b.id = e.target)
  select source, target, type, min(pos) as pos from x where source in (select id from nodes) and target in (select id from nodes) group by 1, 2, 3""")
def _(s, d):
    n, e = graph(s, d)
    mapping = table(s, d, "nation").where("n_nationkey % 2 = 1").select(F.concat(F.lit("prp_"), "n_nationkey").alias("duplicate"), F.concat(F.lit("prp_"), (F.col("n_nationkey") - 1).cast("string")).alias("master"))
    return similarity.rewritten(n.withColumn("text", F.col("name")), e, mapping)[1].select("source", "target", "type", "pos")


@query("a10_duplicate_report", "with l as (select min(pos) as m, text from chunks group by text having count(*) > 1) select pos as duplicate_id, m as master_id, '1.0000' as similarity from chunks join l using (text) where pos > m and text <> ''")
def _(s, d):
    pairs = text_duplicates(s, d)
    return similarity.duplicate_report(similarity.duplicate_map(pairs), pairs)


@query("e1_target_nodes", "select id, type from nodes where definition is not null and trim(definition) <> '' union all select id, type from chunks where regexp_matches(text, '[^ \\t\\r\\n]')")
def _(s, d):
    n, c = table(s, d, "nodes"), table(s, d, "chunks")
    every = n.select("id", "type", F.col("definition").alias("text")).unionByName(c.select("id", "type", "text")).unionByName(n.select("id", F.lit("Slice").alias("type"), F.col("name").alias("text")))
    return similarity.target_nodes(every).select("id", "type")


@query("e5_self_loops", "select count(*) filter (source = target) as removed, count(*) filter (source <> target) as kept from edges")
def _(s, d):
    return similarity.without_self_loops(table(s, d, "edges"))[1]


@query("d8_before_after", """with m as (select 'prp_' || n_nationkey as id, 'prp_' || (n_nationkey - 1) as master from nation where n_nationkey % 2 = 1), x as (select distinct coalesce(a.master, e.source) as source, coalesce(b.master, e.target) as target, e.type from edges e left join m a on a.id = e.source left join m b on b.id = e.target)
  select (select count(*) from nodes) as nodes_before, (select count(*) from nodes where id not in (select id from m)) as nodes_after, (select count(*) from edges) as edges_before,
         (select count(*) from x where source in (select id from nodes) and target in (select id from nodes)) as edges_after""")
def _(s, d):
    n, e = graph(s, d)
    n = n.withColumn("text", F.col("name"))
    mapping = table(s, d, "nation").where("n_nationkey % 2 = 1").select(F.concat(F.lit("prp_"), "n_nationkey").alias("duplicate"), F.concat(F.lit("prp_"), (F.col("n_nationkey") - 1).cast("string")).alias("master"))
    return similarity.before_after((n, e), similarity.rewritten(n, e, mapping))


@query("e2_candidates_of_all", SHINGLES + """, k as (select *, row_number() over (partition by id order by similarity desc, other) as n from r where similarity >= 0.75 and id < other)
  select id as source, other as target, round(similarity, 6) as similarity, case when exists (select 1 from citations c where c.source = k.id and c.target = k.other or c.source = k.other and c.target = k.id) then 'CITES' else '' end as existing from k where n <= 3""")
def _(s, d):
    """Long-range pairs of every chunk with similarity from 0.75 on."""
    near = knn.nearest_of_all(knn.shingle_vectors(table(s, d, "chunks").select(F.col("pos").alias("id"), "text")), 5, least=0.75, target=0.99)
    return similarity.long_range_candidates(near, table(s, d, "citations").withColumn("type", F.lit("CITES"))).withColumn("similarity", F.round("similarity", 6))


@query("e2_candidates")
def _(s, d):
    v = vectors(s, d)
    near = similarity.nearest(v.where("id % 20 = 0"), v, 5)
    edges = table(s, d, "citations").withColumn("type", F.lit("CITES"))
    return similarity.long_range_candidates(near, edges, least=0.2)


@query("e3_proposals", "select source, target, 'SYNTHESIZED_BY' as type from edges where type = 'SYNTHESIZED_BY' and source like 'mat%' group by 1, 2")
def _(s, d):
    n, e = graph(s, d)
    syn = e.where("type = 'SYNTHESIZED_BY'").select("source", "target")
    proposed = syn.distinct().withColumn("type", F.explode(F.array(F.lit("SYNTHESIZED_BY"), F.lit("REFUTES"))))
    return similarity.valid_proposals(proposed, syn, n)


@query("e4_upserts", """select source, target, type, case when pos % 3 = 0 and confidence < 0.95 then 0.95 else confidence end as confidence, case when pos % 3 = 0 and confidence < 0.95 then 'updated' else 'kept' end as origin from edges where type = 'SYNTHESIZED_BY' and source like 'mat%'
  union all select 'new' || source, target, type, 0.95, 'added' from edges where type = 'SYNTHESIZED_BY' and source like 'mat%' and pos % 3 = 0""")
def _(s, d):
    e = table(s, d, "edges").where("type = 'SYNTHESIZED_BY' and source like 'mat%'")
    some = e.where("pos % 3 = 0").select(F.explode(F.array("source", F.concat(F.lit("new"), "source"))).alias("source"), "target", "type", F.lit(0.95).alias("confidence"), "pos")
    return similarity.upsert_edges(e, some).select("source", "target", "type", "confidence", "origin")


@query("e6_pass_statistics", "select coalesce(case when pos % 2 = 0 then 'forward' else 'backward' end, 'total') as pass, type as action, count(*) as n from edges group by 1, 2 union all select 'total', type, count(*) from edges group by 2")
def _(s, d):
    return similarity.pass_statistics(table(s, d, "edges").select(F.when(F.col("pos") % 2 == 0, "forward").otherwise("backward").alias("pass"), F.col("type").alias("action")))


# Sources, sinks, streams


@query("a2_slices_round_trip", f"""with w as (select id, slug, {WORDS} as w from chunks), p as (select id, slug, unnest(range(0, cast(ceil(len(w) / 500.0) as bigint))) as part from w where len(w) > 0)
  select id || '#' || part as id, slug as source_file, part as order_in_file from p""")
def _(s, d):
    where = shared_dir(s)
    parts = T.slices(table(s, d, "chunks").select("id", "text"), 500)
    rows = parts.select(F.concat_ws("#", "id", F.col("part").cast("string")).alias("id"), F.col("part").cast("bigint").alias("order"), F.element_at(F.split("id", ":"), 1).alias("source_file"), F.lit("s").alias("slug"), "text", F.col("token_start").cast("bigint").alias("slice_token_start"), F.col("token_end").cast("bigint").alias("slice_token_end"))
    files.write_slices(rows, where)
    return files.read_slices(s, where).select("id", "source_file", F.col("order").alias("order_in_file"))


@query("a9_triples_round_trip", "select p_name as Subject, 'CHM-PRO' as Rel, p_brand as Object, cast(p_size as bigint) as Count from part")
def _(s, d):
    where = shared_dir(s)
    files.write_triples(table(s, d, "part").select(F.col("p_name").alias("Subject"), F.lit("CHM-PRO").alias("Rel"), F.col("p_brand").alias("Object"), F.col("p_size").cast("bigint").alias("Count")), where)
    return files.read_triples(s, where)


@query("a12_clusters", "select id, lpad(cluster_id::varchar, length((select max(cluster_id) from nodes)::varchar)::integer, '0') as cluster from nodes")
def _(s, d):
    where = shared_dir(s)
    files.write_clusters(table(s, d, "nodes").select("id", "cluster_id"), where)
    return s.read.schema("id string, cluster string").json(where)


@query("a13_event_tail", "select event_id, event_type from events order by ts desc, event_id desc limit 100")
def _(s, d):
    where = shared_dir(s)
    files.append_events(table(s, d, "events").select("event_id", "ts", "event_type"), where)
    return files.tail_events(s, where, "event_id bigint, ts timestamp, event_type string").select("event_id", "event_type")


@query("o1_incremental_slices", "select doc_id as id, n_chars from documents")
def _(s, d):
    where = shared_dir(s)
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    docs.repartition(3).write.parquet(f"{where}/in")
    docs.where("id % 2 = 0").coalesce(1).write.mode("append").parquet(f"{where}/in")
    return jobs.streamed(s, f"{where}/in", docs.schema, jobs.unseen_slices, where, 2)


@query("o2_stream_upsert", "select id, name from nodes")
def _(s, d):
    where = shared_dir(s)
    n = table(s, d, "nodes").select("id", "name")
    n.withColumn("name", F.lit("old")).write.parquet(f"{where}/in")
    stream = s.readStream.schema(n.schema).parquet(f"{where}/in")
    jobs.upsert_graph(stream, f"{where}/out", f"{where}/state", ["id"], "id string, name string").awaitTermination()
    n.write.mode("append").parquet(f"{where}/in")
    jobs.upsert_graph(stream, f"{where}/out", f"{where}/state", ["id"], "id string, name string").awaitTermination()
    return s.read.schema(n.schema).parquet(f"{where}/out/v1")


@query("o3_debounced", """with g as (select *, case when ts - lag(ts) over (partition by event_type order by ts) < interval 3 seconds then 0 else 1 end as fresh from events), b as (select *, sum(fresh) over (partition by event_type order by ts) as k from g)
  select event_type, min(ts) as started, count(*) as events from b group by event_type, k""")
def _(s, d):
    return jobs.debounced(table(s, d, "events")).select("event_type", "started", "events")


@query("o4_rollup", "select date_trunc('hour', ts) as started, event_type, count(*) as events from events group by 1, 2")
def _(s, d):
    return jobs.rollup(table(s, d, "events"))
