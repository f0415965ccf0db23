"""The Merkle manifest, the conversation trie and the chat format against plain versions, on small and odd input."""

import hashlib
import random
import zlib

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf int, pos string, tree string"
CONVS = "conv_id bigint, turn bigint, role string, text string, key string, block int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lower(s):
    return None if s is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def documents(n, langs, seed=1):
    rnd = random.Random(seed)
    texts = [None, "", "Some TEXT", "same", "émoji \U0001f600 Ünd", "x" * 50_000, "plain"]
    rows = [(k, rnd.choice(texts), rnd.choice(langs), rnd.choice(["s", None]), rnd.choice([3, None]), 1, "p", "t") for k in range(n)]
    rows += [(None, "No Id", langs[0], "s", 1, 1, "p", "t"), rows[0], rows[0], (5, "Other of five", rows[5][2], None, None, 1, "p", "t")] if n > 5 else []
    rnd.shuffle(rows)
    return rows


def plain_manifest(rows, fanout):
    def leaf(r, text):
        return sha("".join(field(x) for x in (r[0], r[3], r[2], r[4], text)))

    def climb(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
        return out

    def beside(tree, k):
        for nodes in tree[:-1]:
            run = k - k % fanout
            yield "".join(nodes[run:k]), "".join(nodes[k + 1 : run + fanout])
            k //= fanout

    of = {}
    for r in rows:
        of.setdefault(r[2], []).append(r)
    trees = {}
    for lang, rs in of.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = climb([leaf(r, r[1]) for r in rs])
    order = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    if not rows:
        return
    upper = climb([trees[x][-1][0] for x in order])
    root = upper[-1][0]
    for n, lang in enumerate(order):
        for k, r in enumerate(of[lang]):
            way = [*beside(trees[lang], k), *beside(upper, n)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, lower(r[1]) if tampered else r[1])
            for a, b in way:
                h = sha(a + h + b)
            yield r[0], trees[lang][0][k], trees[lang][-1][0], root, sha("".join(a + b for a, b in way)), h, h == root


@pytest.mark.parametrize(("n", "langs", "fanout", "height"), [(0, ["a"], 8, 4), (1, ["a"], 8, 1), (9, ["a", None], 2, 1), (75, ["de", "en", "en", "en", "en", None, "é", "z"], 2, 1), (150, ["en"], 8, 1), (120, [f"l{k}" for k in range(40)], 3, 1), (60, ["a", "b"], 8, 4)])
def test_merkle_manifest(spark, n, langs, fanout, height):
    from graphloom.llm.merkle import audited

    rows = documents(n, langs)
    got = audited(spark.createDataFrame(rows, DOCS), fanout, height).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in names) for r in got), key=key) == sorted(plain_manifest(rows, fanout), key=key)


def test_radix_tree_layouts():
    from graphloom.llm.trie import Node, tree

    rnd = random.Random(3)
    keys = {b"", b"\0" * 16, b"\0" * 32} | {bytes([k]) * 16 for k in range(256)} | {bytes(rnd.choices(range(60), k=16 * rnd.randint(1, 4))) for _ in range(300)} | {b"\1" * 15 + bytes([k]) for k in range(40)}
    keys = sorted(keys)
    root, found, layouts = tree(keys), [], set()
    stack = [(root, b"")]
    while stack:
        node, at = stack.pop()
        layouts.add(node.size)
        at += node.path
        found += [(at, k) for k in node.ends]
        stack += [(c, at) for c in reversed(node.ordered())]
    assert found == [(k, n) for n, k in enumerate(keys)]
    assert layouts == {4, 16, 48, 256}
    node = Node(b"", 0)
    for byte in [7, 3, 250, *range(60), 3]:
        node.put(byte, Node(bytes([byte]), byte))
    assert [c.row for c in node.ordered()] == [*range(60), 250]
    assert node.get(200) is None and node.get(59).row == 59


def conversations(n, seed=2):
    rnd = random.Random(seed)
    says = [("user", "Hi"), ("assistant", "Hello é"), (None, None), ("user", ""), ("system", "x" * 3000), ("assistant", "b")]
    rows = []
    for c in range(n):
        kind = rnd.random()
        if kind < 0.1:
            continue
        turns = [says[k % 6] for k in range(6)] if kind < 0.5 else [says[0]] + [rnd.choice(says) for _ in range(rnd.randint(0, 11))]
        rows += [(c, None if k == 0 and kind < 0.3 else k, r, t, "k", 1) for k, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    return rows


def plain_trie(rows):
    of = {}
    for r in rows:
        if r[0] is not None:
            role, text = r[2] or "", r[3] or ""
            of.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    of = {c: [t[3:] for t in sorted(ts)] for c, ts in of.items()}
    built = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = of.get(c - c % 5, [])[:h] + own[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = sorted(c for c in members if len(built[c]) == len(key))
        yield (
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below),
            sum(not any(len(j) == len(k) + 1 and j[:-1] == k for j in below) for k in below), sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k), sha(",".join(map(str, ends))),
        )


@pytest.mark.parametrize(("n", "block"), [(0, 4), (1, 4), (70, 1), (70, 3), (70, 1000)])
def test_conversation_trie(spark, n, block):
    from graphloom.llm.trie import conversation_trie

    rows = conversations(n) + ([(10, 3, "user", "tie", "k", 1), (10, 3, "user", "tie", "k", 1), (10, 3, None, "tie", "k", 1), (None, 1, "user", "no id", "k", 1)] if n > 1 else [(100, 1, "user", "x", "k", 1)] * n)
    got = conversation_trie(spark.createDataFrame(rows, CONVS), block).collect()
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    key = lambda r: (r[1], r[0])
    assert sorted((tuple(r[c] for c in names) for r in got), key=key) == sorted(plain_trie(rows), key=key)


def test_conversation_trie_of_copies(spark):
    from graphloom.llm.trie import conversation_trie

    rows = [(c, k, "user", f"turn {k}", "k", 1) for c in range(0, 200, 5) for k in range(4)] + [(7, 0, "user", "y" * 200_000, "k", 1)]
    got = conversation_trie(spark.createDataFrame(rows, CONVS), 8).where("n_convs > 1").collect()
    assert sorted(tuple(r) for r in got) == sorted(r for r in plain_trie(rows) if r[3] > 1)
    assert max(r["n_convs"] for r in got if r["depth"] == 4) >= 40  # over five blocks, their ids one stream


def plain_chat(rows):
    of = {}
    for r in rows:
        of.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for c, ts in of.items():
        ts.sort()
        loss = "".join(t[3] for t in ts if t[2] == "assistant")
        yield c, len(ts), sha("".join(f"{t[2]}\n{t[3]}\n" for t in ts)), len(loss), sha(loss)


ODD = ["\\", "\\\\", "<turn", "</turn>\n", "</turn", "<\\turn", "\\o\\c\\n", "a\nb", "<turn>assistant\nx</turn>\n", "<", "\\### Assistant: </turn> ok", "\U0001f600\\<turn", "", None, "\0 \r\n", "<" * 5 + "/turn>" * 3, "long </turn>\n" * 4000]


def test_chat_format(spark):
    from graphloom.llm.chat import formatted, probe, read_back

    rnd = random.Random(5)
    rows = [(c, rnd.choice([None, *range(9)]), rnd.choice(["assistant", "user", None, "odd\nrole\\n</turn>", "assistant"]), rnd.choice(ODD), "k", 1) for c in [*range(30), None] for _ in range(rnd.randint(1, 9))]
    rows += [(40, k, "user", "only", "k", 1) for k in range(3)] + [rows[0]] * 3
    examples = formatted(spark.createDataFrame(rows, CONVS)).cache()
    got = read_back(examples).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(plain_chat(rows), key=key)
    for c in (0, 3, 40, None):
        turns = sum(r[0] == c for r in rows)
        mine = sorted((e for e in examples.collect() if e["conv_id"] == c), key=lambda e: e["example"])
        assert [e["text"].count("</turn>\n") for e in mine][-1] == turns
        for a, b in zip(mine, mine[1:], strict=False):  # all turns before the reply are its context
            assert b["text"].startswith(a["text"])
        for e in mine:
            assert e["text"].startswith("<turn>") and e["text"].endswith("</turn>\n")
            assert e["loss_end"] in (len(e["text"]), len(e["text"]) - 8)
    assert {r["conv_id"]: r["formatted_chars"] for r in got} == {c: sum(len(e["text"]) for e in examples.collect() if e["conv_id"] == c) for c in {r[0] for r in rows}}
    assert read_back(formatted(spark.createDataFrame([], CONVS))).count() == 0
    (r,) = read_back(formatted(probe(spark))).collect()
    assert tuple(r)[:5] == next(plain_chat([(-7, 0, "user", ODD[10]), (-7, 1, "assistant", ODD[10])]))


def test_warc_null_and_repeated_ids(spark):
    from graphloom.llm import warc

    rows = [(None, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, "v", "b"), (None, "w", "b"), (2, None, None), (3, "u x", "")] + [(k, "u", "same") for k in range(10, 15)]
    got = [tuple(r) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)).collect()]
    by = lambda n: sorted(((r[0], r[3], r[4]) for r in got if r[2] == warc.digest(n)), key=str)
    assert by(b"<p>a</p>") == sorted([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1)], key=str)
    assert by(b"b") == [(None, "response", None), (None, "revisit", None)]
    assert by(b"") == [(2, "revisit", 3), (3, "response", None)]
    assert by(b"same") == [(k, "revisit", 14) for k in range(10, 14)] + [(14, "response", None)]
    named = spark.createDataFrame([("a b\r\n", "u", "x"), ("None", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    assert {tuple(r)[0::3] for r in warc.archive_pages(named).collect()} == {("a b\r\n", "response"), ("None", "revisit"), (None, "response")}


def test_mixing_with_many_passes(spark, sf):
    from graphloom.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.taken(mixing.mix(docs, share=4.5, cap=5, keep=False)).collect()
    words = sum(r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == pytest.approx(4.5 * words, rel=0.001) and all(r["taken"] <= 5 * r["size"] for r in rows)
    of = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    near = {}
    for r in rows:
        near[of[r["doc_id"]]] = near.get(of[r["doc_id"]], -r["target"]) + r["taken"]
    assert all(abs(x) <= 1 for x in near.values())


def test_free_spans(spark):
    from pyspark.sql import functions as F

    from graphloom.llm import spans as S

    rnd = random.Random(11)

    def some(n, kinds, width, apart):
        return [(rnd.choice(kinds), at, at + rnd.randint(1, width), "t", "b") for at in sorted(rnd.sample(range(n * apart), n))]

    cases = [(some(a, "xy", w, 9), some(b, "pq", w, 9)) for a, b, w in [(0, 0, 3), (5, 0, 3), (0, 5, 3), (40, 60, 12), (700, 600, 7), (900, 900, 40)]]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cases)], f"id int, a {S.SPAN}, b {S.SPAN}")
    got = {r["id"]: r for r in df.select("id", S.free(F.col("a"), F.col("b")).alias("free"), S.first_of_each(F.col("a")).alias("first")).collect()}
    for k, (a, b) in enumerate(cases):
        assert [tuple(x) for x in got[k]["free"]] == [x for x in a if not any(y[1] < x[2] and x[1] < y[2] for y in b)]
        first, end = [], -1
        for x in sorted(a, key=lambda x: (x[1], x[0])):
            if end <= x[1]:
                first.append(x)
                end = x[2]
        assert [tuple(x) for x in got[k]["first"]] == first


def test_many_spans_in_one_text(spark):
    import time

    from graphloom.llm import pii, secrets

    text = " ".join(f"m{k}@x.org tel 555 {k:07d} key 0123456789abcdef0123456789abcd{k:05x} Zq{k:05d}Xw{k:05d}Kj " for k in range(16_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for module in (pii, secrets):
        began = time.time()
        r = module.digest(module.scan(docs)).first()
        assert (r["n_email"] if module is pii else r["n_hex"]) == 16_000 and time.time() - began < 120
