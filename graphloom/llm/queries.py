"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.lm import score

    return score(_table(spark, sf_dir, "documents"), order=3)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.jaccard import components

    return components(_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.tokens import token_output

    return token_output(_table(spark, sf_dir, "documents"), _vocabulary())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secrets import digest, scan

    return digest(scan(_table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.exact import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontam import judged, scan

    return judged(scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import mix, taken

    return taken(mix(_table(spark, sf_dir, "documents"), keep=False))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pii import digest, scan

    return digest(scan(_table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.merkle import audited

    return audited(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.chat import formatted, probe, read_back

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(formatted(rows.unionByName(probe(spark))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_output": op3_token_output,
    "op4_secrets": op4_secrets,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_chat_format": op13_chat_format,
}

#: CRC-32 of an integer's decimal digits: a byte is taken in, then comes a shift for each bit (the entries below zero).
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast({} as varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295)"""


def _merkle_sql(low: int = 7, high: int = 3, fanout: int = 8) -> str:
    """The manifest by so many levels of runs for the languages and above them; a level of one node changes nothing."""
    field = "coalesce(octet_length(encode(cast({0} as varchar))) || ':' || cast({0} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"l as (select doc_id, lang, {leaf('text')} as leaf, case when {_CRC.format('doc_id')} % 3 = 0 then {leaf(lower)} else {leaf('text')} end as other from documents)",
        "w0 as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, other as fold, '' as proof from l)",
        "n0 as (select lang as tree, pos, leaf as h from w0)",
    ]
    for k in range(low + high):
        if k == low:  # the languages' roots are the leaves above
            steps.append(f"s as (select tree as lang, h as subroot, row_number() over (order by tree nulls first) - 1 as n from n{k})")
            steps.append(f"n{k}x as (select cast(null as varchar) as tree, n as pos, subroot as h from s)")
            steps.append(f"w{k}x as (select w.* replace (s.n as pos), s.subroot from w{k} w join s on w.lang is not distinct from s.lang)")
        nodes, ways = (f"n{k}x", f"w{k}x") if k == low else (f"n{k}", f"w{k}")
        own = "cast(null as varchar)" if k >= low else "w.lang"
        steps.append(f"r{k} as (select tree, pos // {fanout} as run, list(h order by pos) as hs, any_value(c) as c from (select *, count(*) over (partition by tree) as c from {nodes}) group by all)")
        steps.append(f"n{k + 1} as (select tree, run as pos, case when c > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h from r{k})")
        a, b = f"array_to_string(hs[1 : w.pos % {fanout}], '')", f"array_to_string(hs[w.pos % {fanout} + 2 : ], '')"
        a = f"case when w.pos % {fanout} = 0 then '' else {a} end"
        steps.append(
            f"w{k + 1} as (select w.* replace (w.pos // {fanout} as pos, case when c > 1 then sha256({a} || fold || {b}) else fold end as fold, case when c > 1 then proof || {a} || {b} else proof end as proof)"
            f" from {ways} w join r{k} r on {own} is not distinct from r.tree and w.pos // {fanout} = r.run)"
        )
    top = low + high
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, root.h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = root.h as verified from w{top}, n{top} as root"


ORACLE: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op12_conversation_trie": f"""
        with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
        i as (select *, sha256(octet_length(encode(role)) || ':' || role || text) as id from t),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, id) as place from i),
        c as (select distinct conv_id, conv_id - conv_id % 5 as head, {_CRC.format("conv_id")} % 9 as h from o),
        b as (select c.conv_id, 0 as part, o.place, o.id, octet_length(encode(o.text)) as size from c join o on o.conv_id = c.head and o.place <= c.h
              union all select c.conv_id, 1, o.place, o.id, octet_length(encode(o.text)) from c join o on o.conv_id = c.conv_id and o.place > c.h),
        d as (select conv_id, row_number() over w as depth, string_agg(id, '') over w as key, size from b window w as (partition by conv_id order by part, place rows between unbounded preceding and current row)),
        p as (select conv_id, depth, key, size from d union all select conv_id, 0, '', 0 from c),
        e as (select conv_id, max(depth) as len from p group by conv_id),
        n as (select p.depth, p.key, any_value(p.size) as size, min(p.conv_id) as conv_id, count(*) as n_convs,
                     string_agg(case when e.len = p.depth then p.conv_id end, ',' order by p.conv_id) as ends
              from p join e using (conv_id) group by p.depth, p.key),
        k as (select depth - 1 as depth, left(key, length(key) - 64) as key, count(*) as n_children from n where depth > 0 group by all),
        x as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (depth, key)),
        s as (select a.depth, a.key, count(*) filter (b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.size)::bigint as saved_tokens
              from x a join x b on b.depth >= a.depth and starts_with(b.key, a.key) group by a.depth, a.key)
        select x.conv_id, x.depth, u.conv_id as parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(x.ends, '')) as ends_sha256
        from x join s using (depth, key) left join n u on u.depth = x.depth - 1 and u.key = left(x.key, length(x.key) - 64)""",
    "op13_chat_format": r"""
        with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        m as (select *, length(replace(replace(replace(replace(role, '\', '\\'), '<turn', '\o'), '</turn', '\c'), chr(10), '\n'))
                        + length(replace(replace(replace(text, '\', '\\'), '<turn', '\o'), '</turn', '\c')) + 15 as chars from t),
        r as (select *, sum(chars) over w as upto, row_number() over w as place, count(*) over (partition by conv_id) as n from m
              window w as (partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and current row))
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
               sum(upto) filter (role = 'assistant' or place = n)::bigint as formatted_chars
        from r group by conv_id""",
    "op5_exact_dedup": """
        with t as (select doc_id, coalesce(text, '') as x from documents)
        select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
               doc_id = max(doc_id) over (partition by x) as kept, sha256(x) as text_sha256
        from t""",
    "op9_mixing": r"""
        with d as (select doc_id, source, md5('17:' || cast(doc_id as varchar)) as h,
                          coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as n from d group by source),
        w as (select *, case (n - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w from s),
        l as (select *, (source_size * 2)::double as cap, (source_size * 2)::double / w as lv, sum(source_size) over () * 1.5::double as t from w),
        f as (select *, coalesce(sum(cap) over (order by lv, n rows between unbounded preceding and 1 preceding), 0)
                        + lv * sum(w) over (order by lv, n rows between current row and unbounded following) <= t as capped from l),
        g as (select *, case when capped then cap else (t - sum(case when capped then cap else 0 end) over ()) * w
                        / sum(case when capped then 0 else w end) over () end as target from f),
        p as (select source, source_size, target, case when source_size > 0 then least(2, floor(target / source_size))::bigint else 0 end as k from g),
        r as (select *, greatest(0, round(target)::bigint - k * source_size) as rest from p),
        o as (select d.*, coalesce(sum(size) over (partition by source order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as c from d)
        select o.doc_id, o.size, r.source_size, r.target, (k * size + greatest(0, least(size, rest - c)))::bigint as taken
        from o join r on o.source is not distinct from r.source""",
}
