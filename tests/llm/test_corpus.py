"""Duplicates, secrets, quality, archives, code search and the pipeline against plain versions."""

import hashlib
import random

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tamis.llm import codes, linedup, linking, neardup, quality, secrets, warc
from tamis.llm.flat import token_file
from tamis.llm.lanes import pack


def plain(corpus):
    return [(i, t) for i, t, *_ in corpus]


@pytest.mark.parametrize("small", [128, 2])
def test_near_duplicates(docs, corpus, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", small)  # 2: the trees branch down to their depth
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates(plain(corpus))


def test_near_duplicates_odd_ids(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "A B c d e f"), (None, "a b c d e f"), (3, None), (4, ""), (5, "x"), (6, "X")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).drop("text_hash")
    assert sorted(map(tuple, got.where("doc_id is not null").collect())) == [
        (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)]
    assert [tuple(r) for r in got.where("doc_id is null").collect()] == [(None, 2, None, True)]


def test_an_id_with_several_texts_loses_none(spark):
    """Texts that nothing else has stay, whatever their id; copies go, whatever theirs."""
    draw = random.Random(12)
    base = [" ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(40)) for _ in range(5)]
    line = [" ".join("".join(draw.choice("klmnopqrst") for _ in range(6)) for _ in range(8)) for _ in range(6)]
    rows = [(7, base[0]), (7, base[1]), (7, base[2]), (8, base[1]), (9, base[3]), (9, base[3]), (3, base[2] + " more"), (7, None), (7, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = neardup.near_duplicates(table)
    left = sorted((r.doc_id, r.text) for r in neardup.without_copies(table, found).collect() if r.text)
    assert left == sorted([(7, base[0]), (7, base[1]), (9, base[3]), (9, base[3]), (3, base[2] + " more")])
    rows = [(5, f"{line[0]}\n{line[1]}"), (5, f"{line[2]}\n{line[3]}"), (6, f"{line[3]}\n{line[4]}"), (4, f"{line[1]}\n{line[5]}")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = sorted((r.doc_id, r.text) for r in linedup.without_repeats(table, linedup.line_groups(table)).collect())
    assert sorted(x for _, t in cut for x in t.split("\n")) == sorted(line)


def test_a_large_group_of_near_copies_is_not_copied_by_blocks(spark, monkeypatch):
    """Rows of the blocks grow with the members of a group, not with their square, and the links are whole."""
    rows = []
    compare = linking.compare_blocks

    def counted(members, *a, **k):
        rows.append(members.count())
        return compare(members, *a, **k)

    monkeypatch.setattr(linking, "compare_blocks", counted)
    draw = random.Random(3)
    text = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    sizes = {}
    for n in (100, 300):
        made = []
        for i in range(n):
            w = list(text)
            for _ in range(draw.randrange(3, 7)):
                w[draw.randrange(300)] = f"x{draw.randrange(10**9)}"
            made.append((i, " ".join(w)))
        rows.clear()
        got = neardup.near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string"))
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute.near_duplicates(made)
        sizes[n] = sum(rows)
    assert sizes[300] <= 8 * max(sizes[100], 100)


def test_a_line_in_all_documents_makes_no_rows_by_the_square(spark, monkeypatch):
    """Different documents that share a line lie in large nodes; these branch on, and what is joined for the blocks has a row per member."""
    joined, monkey = [], linking.Sketches.with_partner

    def counted(self, rows, *a):
        joined.append(rows.count())
        return monkey(self, rows, *a)

    monkeypatch.setattr(linking.Sketches, "with_partner", counted)
    monkeypatch.setattr(linking, "FEW", 0)
    monkeypatch.setattr(neardup, "SMALL", 16)
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    line = [word() for _ in range(20)]
    made = [(i, " ".join(line + [word() for _ in range(30)])) for i in range(600)]
    made += [(1000 + i, t + " more") for i, t in made[::50]]
    got = neardup.near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute.near_duplicates(made)
    assert sum(joined) <= 8 * len(made)


def test_blocks_of_sketches_lose_no_link(spark, monkeypatch):
    """Blocks of sketches above one block of sets, several nodes in a call, and a member on both sides."""
    monkeypatch.setattr(linking, "SKETCH_BLOCK", 24)
    draw = random.Random(6)
    sets = {k: set(range(k % 5 * 100, k % 5 * 100 + 40)) - {k % 5 * 100 + draw.randrange(40)} for k in range(90)}
    raw = [(k, bytearray(np.array(sorted(s), np.uint64).tobytes()), bytearray([k % 5 + 1] * 8)) for k, s in sets.items()]
    table = spark.createDataFrame(raw, "id bigint, set binary, signature binary")
    members = spark.createDataFrame([(k % 2, k) for k in sets] + [(2, k) for k in range(10)], "node bigint, id bigint")
    marked = linking.open_members(members, spark.createDataFrame([], "node bigint, component bigint"))
    blocks = linking.compare_blocks(marked, lambda ids: table.select("id", "set"), 75, 8, linking.Sketches(table.select("id", "signature"), 8, "u1"))
    got = {r.node: r.component for r in linking.connected_components(blocks).collect()}
    assert got == {k: k % 5 for k in sets}


def test_near_duplicates_of_nothing(no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0


def test_open_nodes_are_compared_in_blocks(spark):
    """Members that link with each other and not with the node's smallest member are found, over several blocks."""
    draw = random.Random(2)
    sets = {0: set(range(10_000, 10_040))}
    for k in range(1, 40):
        group = k % 3
        sets[k] = set(range(group * 100, group * 100 + 40)) - {group * 100 + draw.randrange(40)}
    table = spark.createDataFrame([(k, bytearray(np.array(sorted(s), np.uint64).tobytes())) for k, s in sets.items()], "id bigint, set binary")
    members = spark.createDataFrame([(7, k) for k in sets], "node bigint, id bigint")
    got = {r.node: r.component for r in linking.link(members, lambda ids: table.join(ids, "id", "left_semi"), 75).collect()}
    assert got == {k: (k % 3 or 3) for k in range(1, 40)}
    marked = linking.open_members(members.unionByName(members.withColumn("node", F.lit(8).cast("long"))), spark.createDataFrame([], "node bigint, component bigint"))
    assert marked.select("node").distinct().count() == 1  # of two nodes with the same members one is open
    blocks = linking.compare_blocks(marked, lambda ids: table, 75, block=8)
    assert blocks.count() < 40 * 10
    found = {r.node: r.component for r in linking.connected_components(blocks).collect()}
    assert found == got


def test_line_groups(docs, corpus):
    got = {(r.doc_id, r.line): (r.component_id, r.kept) for r in linedup.line_groups(docs).collect()}
    want = brute.line_groups(plain(corpus))
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    pairs = {(got[k][0], want[k][0]) for k in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    cut = {r.doc_id: r.text for r in linedup.without_repeats(docs.where("text is not null"), linedup.line_groups(docs)).collect()}
    assert cut == dict(brute.without_repeats([(i, t) for i, t in plain(corpus) if t is not None]))


def test_line_groups_odd(spark, no_docs):
    assert linedup.line_groups(no_docs).count() == 0
    rows = [(None, "same line here\nother"), (3, "same line here"), (3, "same line here"), (1, "\r\n  same line here\t\n")]
    got = linedup.line_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.line, r.kept) for r in got)) == [
        (False, 0, 0, True), (False, 0, 1, True), (True, 1, 1, False), (True, 3, 0, False), (True, 3, 0, False)]


def test_secrets(docs, corpus, no_docs):
    found = secrets.scan(docs)
    report = {r.doc_id: r for r in secrets.span_report(found).collect()}
    want = brute.secrets([(i, t, s) for i, t, _, s, _ in corpus])
    names = ("assign", "access", "hex", "owned")
    for (i, *_), spans in zip(corpus, want, strict=True):
        r = report[i]
        assert r.base_sha256 == brute.base_digest(spans)
        assert r.spans == ",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex, r.n_owned) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert r.n_live == sum(s[3] for s in spans)
    assert any(r.n_owned for r in report.values()) and any(r.n_assign for r in report.values())
    texts = {r.doc_id: r.text for r in secrets.without_secrets(docs, found).collect()}
    assert texts == {i: t and brute.redacted(t, s) for (i, t, *_), s in zip(corpus, want, strict=True)}
    assert secrets.span_report(secrets.scan(no_docs)).count() == 0


def test_copied_examples_are_not_live(spark):
    rows = [(k, f"token = EXAMPLEKEY1 {'x' * k}", f"s{k % 4}") for k in range(8)] + [(9, "token = OWNKEY12345", "s1"), (9, "token = OWNKEY12345", "s1")]
    found = secrets.span_report(secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))).collect()
    assert sorted((r.doc_id, r.n_live) for r in found) == [*((k, 0) for k in range(8)), (9, 1), (9, 1)]


def test_no_python_in_the_secret_scan(docs):
    plan = secrets.candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality(docs, corpus, no_docs):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t, lang, *_ in corpus:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
        assert not (r.base_failed and r.kept)
        assert r.band == (lang if lang in quality.LANGUAGES else "other" if t and "中" in t else "latin")
    assert quality.quality(no_docs).count() == 0
    both = quality.judged(docs)
    assert both.columns == [*docs.columns, "verdict"] and both.count() == len(corpus)


def test_long_words_and_lines_that_differ(spark):
    """A Thue-Morse word over two letters and its complement are different lines and words; plain polynomials modulo 2^64 take them for equal."""
    signs = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)
    rows = [(1, f"{one}\n{two}\n{one}"), (2, f"w x {one} y z"), (3, f"w x {two} y z")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    assert {r.doc_id: r.n_dup_lines for r in quality.quality(table).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(table).collect()} == {1: 1, 2: 2, 3: 3}


def test_fertility_bands(spark):
    """Prose in its language is kept; text that the vocabulary takes apart isn't."""
    prose = ("The committee met in the morning to discuss how the new library should be built and who would pay for it. Several members "
             "thought that the old station could serve well, since it stands empty and lies close to the river. Others feared the cost of "
             "repairs and asked for a careful survey before any decision is made by the council in the autumn of this year.")
    draw = random.Random(1)
    noise = " ".join("".join(chr(draw.randrange(0x1200, 0x1380)) for _ in range(5)) for _ in range(60))
    mash = " ".join("".join(draw.choice("qxzjkvwQXZJKVW0123456789") for _ in range(9)) for _ in range(60))
    rows = [(1, prose, "en"), (2, prose, None), (3, noise, "en"), (4, mash, "en"), (5, "naïve café " * 30, "fr")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[1].kept and got[2].kept and not got[3].kept and not got[4].kept and not got[5].kept
    tokens = sentencepiece.SentencePieceProcessor(model_file=token_file(quality.MODEL)).encode(prose)
    share = np.unique(tokens, return_counts=True)[1] / len(tokens)
    assert abs(got[1].entropy + (share * np.log2(share)).sum()) < 1e-9 and abs(got[1].chars_per_token - len(prose) / len(tokens)) < 1e-9


def test_symbols_between_words(spark):
    """Prose stays in every language; the same prose with a symbol after every word or every second word goes, long or short."""
    draw, rows = random.Random(3), []
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    for n in (90, 400, 1500):
        w = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(n)]
        marked = [x + draw.choice(["###", "$$$", "%%%", "&&&", "***"]) for x in w]
        table = [x + " |" * (k % 2) for k, x in enumerate(w)]
        rows += [(len(rows) + k, " ".join(x), lang, k % 3 == 0) for k, (lang, x) in enumerate((g, x) for g in quality.LANGUAGES for x in (w, marked, table))]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, good boolean")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i: got[i].kept for i, *_ in rows} == {i: good for i, *_, good in rows}


def test_archives(spark, tmp_path):
    same = "é" * 600
    rows = [(1, "http://a/1", same), (2, "http://a/2\r\nX: y", same), (3, None, None), (4, "", "short"), (5, "u", "short"), (6, "u", "z" * 999),
            (7, "u", "z" * 999), (8, "u", "w" * 1000), (9, "u", "w" * 1000), (10, "http://big", "b" * 300_000), (None, "u", same)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int").repartition(3)
    runs = warc.write_warc(pages, folder=str(tmp_path / "w"), file_bytes=2000)
    got = {r.page_id: tuple(r)[1:] for r in warc.page_records(warc.read_warc(spark, runs)).collect()}
    for i, _, html in rows:
        payload = (html or "").encode()
        keeper = max((j or 0 for j, _, h in rows if h == html), default=i) if len(payload) >= 1000 else i
        assert got[i] == (len(payload), hashlib.sha1(payload).hexdigest(), "response" if keeper == i else "revisit", None if keeper == i else keeper)
    folder = str(tmp_path / "w")
    everything = warc.read_warc(spark, folder)
    assert everything.count() == len(rows)
    assert warc.read_warc(spark, folder, record_types=("revisit",)).count() == 3
    assert everything.where("record_type = 'revisit'").select("record_id").count() == 3
    assert [r.content_length for r in warc.read_warc(spark, folder, headers={"WARC-Target-URI": "http://big"}, columns=("content_length",)).collect()] == [
        300_000 + 83]
    pushed = warc.WarcReader({"path": folder}, ("record_id",))
    left = list(pushed.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3)]))
    assert len(left) == 1 and pushed.tests == [("record_type", frozenset(["revisit"]))]
    assert sum(b.num_rows for p in pushed.partitions() for b in pushed.read(p)) == 3
    assert warc.page_records(warc.read_warc(spark, warc.write_warc(pages.limit(0)))).count() == 0


def test_foreign_archive(spark, tmp_path):
    """Plain records of other kinds, several gzip members and a whole file in one member."""
    import gzip

    def record(kind, body, **more):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n{head}\r\n".encode() + body + b"\r\n\r\n"

    parts = [record("warcinfo", b"software: x\r\n"), record("resource", b"\r\n\r\nraw", Content_Type="text/plain", WARC_Record_ID="<urn:page:7>"), record("metadata", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in rows) == sorted([("warcinfo", b"software: x\r\n"), ("resource", b"\r\n\r\nraw"), ("metadata", b"")] * 3)


@pytest.mark.parametrize("width", [None, 8, 16])
@pytest.mark.parametrize("bits", [64, 256, 70])
def test_nearest_codes(spark, width, bits):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(300, bits))
    vectors[50:80] = vectors[50]  # equal codes
    vectors[80:90] = vectors[50] + draw.normal(size=(10, bits)) * 0.3
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)] + [(300, None), (301, [float("nan")] * bits), (302, [1.0] * 3), (303, [None, 1.0]), (304, []),
                                                                            (0, [float(x) for x in vectors[0]])]
    table = spark.createDataFrame(rows, "id bigint, e array<double>").select("id", codes.sign_code(F.col("e")).alias("code"))
    signs = {i: sum(1 << k for k, x in enumerate(v) if x is not None and x > 0) for i, v in rows if v is not None}
    got = {}
    for r in codes.nearest_codes(table, table.where("id % 25 = 0"), 12, width, shard_rows=70, block_queries=5, lanes=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    assert set(got) == {i for i in signs if i % 25 == 0}
    for q in got:
        best = sorted(((signs[q] ^ b).bit_count(), i) for i, b in signs.items() if i != q)[:12]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(best)]


def test_radii_stop_at_the_kth_distance():
    """Where the neighbours are near, few rows are verified and few values probed; a later shard without a nearer row ends at once."""
    draw = np.random.default_rng(6)
    n = 20_000
    base = draw.integers(-(1 << 63), 1 << 63, (n, 1), dtype=np.int64)
    base[:15] = base[0] ^ (1 << np.arange(15)[:, None])
    shard = {"rows": n, "ids": pack(np.arange(n)), "x": pack(base)}
    search = codes.CodeSearch({"rows": 1, "ids": pack(np.array([-1])), "x": pack(base[:1] ^ 1)}, 10)
    search.scan(shard)
    assert (-search.best.scores <= 2).all() and search.verified < n // 20 and search.probes <= 4 * 17
    assert search.best.ids[0].tolist() == sorted(range(n), key=lambda i: (int(base[i, 0] ^ base[0, 0] ^ 1).bit_count() if base[i, 0] ^ base[0, 0] ^ 1 >= 0 else 64, i))[:10]
    probes = search.probes
    search.scan({"rows": n, "ids": pack(np.arange(n, 2 * n)), "x": pack(draw.integers(-(1 << 63), 1 << 63, (n, 1), dtype=np.int64))})
    assert search.probes - probes <= 4 * 17


def test_few_codes(spark):
    table = spark.createDataFrame([(0, [5]), (1, [7]), (2, [-1])], "id bigint, code array<bigint>")
    got = sorted((r.query_id, r.rank, r.id, r.distance) for r in codes.nearest_codes(table, table.where("id = 0"), 10).collect())
    assert got == [(0, 1, 1, 1), (0, 2, 2, 62)]
    assert codes.nearest_codes(table.limit(0), table, 3).count() == 0
    assert codes.nearest_codes(table, table.limit(0), 3).count() == 0


def test_pipeline(spark, docs, corpus, tmp_path):
    """Each stage on its own input, then run() over written tables."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    table = docs.select(columns)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    current = table
    state = dict(plain(corpus))
    owner = {r[0]: r[3] for r in corpus}
    for (name, stage), number in zip(corpus_pipeline.STAGES[:-1], range(4), strict=True):
        current = stage(spark, current, str(tmp_path))
        assert current.columns == columns
        current.write.parquet(str(tmp_path / f"s{number}"))
        current = spark.read.parquet(str(tmp_path / f"s{number}"))
        got = {r.doc_id: r.text for r in current.collect()}
        if number == 0:
            kept = {r.doc_id for r in quality.quality(table).where("kept").collect()}
            state = {i: t for i, t in state.items() if i in kept}
            assert all(i in got for i in range(0, 400, 10))  # plain prose stays
        elif number == 1:
            state = dict(brute.without_repeats(sorted(state.items())))
        elif number == 2:
            near = brute.near_duplicates(list(state.items()))
            state = {i: t for i, t in state.items() if near[i][2]}
        else:
            order = sorted(state)
            found = brute.secrets([(i, state[i], owner[i]) for i in order])
            state = {i: brute.redacted(state[i], s) for i, s in zip(order, found, strict=True)}
        assert got == state, name
        assert all(r.n_chars == len(r.text) for r in current.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(state)
