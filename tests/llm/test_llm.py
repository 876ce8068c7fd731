"""Brute-force checks on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentryflow.llm import ann, decontaminate, language_id, line_dedup, mixing, near_dedup, packing, pii, repeats, warc

SCHEMA = "doc_id long, text string, lang string, source string, n long"


def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "size", "key", "t", "rep")})


def words(rng, n, vocab=5000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(60, 200)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for j in range(30):
        w = base[j % 3].split()
        w[rng.randrange(len(w))] = f"x{j}"
        rows.append((100 + j, " ".join(w)))
    rows += [(200, base[0]), (201, base[0]), (202, None), (203, ""), (204, "a b"), (205, "A  b"), (206, " \n "), (207, words(rng, 30_000)), (None, base[0]), (200, base[0])]
    return rows


def components(rows):
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(" ")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", " ".join(w)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                k = len(sets[x] & sets[y])
                if 100 * k >= 85 * (len(sets[x]) + len(sets[y]) - k):
                    a, b = find(x), find(y)
                    up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, corpus, monkeypatch):
    want = components([r for r in corpus if r[0] is not None])
    d = docs(spark, [(i, t, "en", "s") for i, t in corpus])
    for block in (2048, 5):  # the second cuts long lists and components into tiles
        monkeypatch.setattr(near_dedup, "LIST_BLOCK", block)
        got = near_dedup.near_duplicates(d).collect()
        assert len(got) == len(corpus)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0


def test_repeated_passages(spark, corpus):
    rng = random.Random(9)
    shared = words(rng, 60)
    rows = [r for r in corpus if r[0] is not None] + [(300 + i, f"{words(rng, 40)} {shared} {words(rng, 70)}") for i in range(3)]
    places = {}
    text = {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").lower().split()
        text[n] = w
        for s in range(len(w) - 49):
            places.setdefault(tuple(w[s : s + 50]), []).append((n, s))
    covered = {n: set() for n in text}
    for at in places.values():
        if len(at) > 1:
            for n, s in at:
                covered[n] |= set(range(s, s + 50))
    want = sorted((rows[n][0], len(covered[n])) for n in text)
    got = repeats.repeated_passages(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted((r.doc_id, sum(s.stop - s.start for s in r.spans)) for r in got) == want
    assert all(r.spans[0].start == 40 and r.spans[0].stop == 100 for r in got if r.doc_id >= 300)
    assert repeats.repeated_passages(docs(spark, [(1, None, None, None)]).limit(0)).count() == 0


def test_line_dedup(spark):
    line = "this line is long enough to count"
    rows = [(1, f"a\n{line}"), (2, f" {line.upper()}\t\nb"), (3, f"{line}\n{line}"), (4, f"{line}\nend"), (5, None), (6, ""), (None, line), (7, "short\nshort"), (1, f"a\n{line}")]
    got = line_dedup.line_dedup(docs(spark, [(i, t, "en", "s") for i, t in rows]), batches=3, fanout=2)
    assert sorted((r.doc_id or 0, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()) == sorted(
        [(1, "a", 2, 1), (1, "a", 2, 1), (2, "b", 2, 1), (3, "", 2, 2), (4, f"{line}\nend", 2, 0), (5, "", 1, 0), (6, "", 1, 0), (0, line, 1, 0), (7, "short\nshort", 2, 0)]
    )
    assert line_dedup.line_dedup(docs(spark, [(1, None, None, None)]).limit(0)).count() == 0


def test_level_compaction(spark):
    runs = line_dedup.LineRuns(fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, 10 - b, 1), (2, b, 10 - b, 1)], "h1 long, h2 long, owner long, docs long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    merged = {(r.h1, r.h2): (r.owner, r.docs) for r in runs.merged(runs.runs()).collect()}
    assert merged[(1, 1)] == (10, 5) and merged[(2, 3)] == (7, 1)


def fill(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        left, open_ = budget - sum(capped.values()), [s for s in names if s not in capped]
        target = {s: left * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if target[s] > 2 * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(900, None, None, "z"), (901, "", "en", "z"), (None, "x y", "en", "a")]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = fill(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in own) - want[s]) <= 60
    assert all(r.taken <= 2 * r.size for r in got) and sorted(map(str, got)) == sorted(map(str, mixing.mix(d).collect()))
    assert mixing.mix(d.limit(0)).count() == 0


def test_decontaminate(spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randrange(14, 60))) for i in range(20)] + [(90, None), (91, "too short"), (92, ""), (None, words(rng, 20))]
    rows = [(i, words(rng, 150)) for i in range(20)]
    rows += [(100 + i, f"{words(rng, 30)} {items[i][1].upper()}, {words(rng, 30)}") for i in range(20)] + [(200, None), (201, ""), (202, "a"), (None, "a b c d e f")]
    d = docs(spark, [(i, t, "en", "s") for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(d, bench).collect()}
    assert set(got) == {(100 + i, i) for i in range(20)} and all(r.similarity == 1 and r.start_shingle == 30 for r in got.values())
    kept = decontaminate.decontaminate(d, bench)
    assert kept.columns == d.columns and kept.count() == len(rows) - 20
    assert decontaminate.matches(d.limit(0), bench).count() == 0 and decontaminate.matches(d, bench.limit(0)).count() == 0


def test_packing_round_trip(spark, corpus):
    rows = corpus + [(300, "tail \n two  spaces "), (301, "Ünïcode, числа ½² 12 don't\x1c x"), (302, None), (303, "x" * 5000), (None, "second without id")]
    tok = packing.Tokenizer()
    for _, t in rows:
        assert tok.encode(t or "").tolist() == tok.encoding.encode_ordinary(t or "")
    d = docs(spark, [(i, t, "en", "s") for i, t in rows])
    for packed in (packing.pack(d, length=128, block_tokens=4000).collect(), packing.read_matrix(packing.write_packed(d, length=128, block_tokens=4000)).collect()):
        parts, whole = {}, []
        for r in packed:
            assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens == len(r.ids) <= 128
            for d_id, off, a, z in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
                assert r.position_ids[a:z] == list(range(z - a))
                parts.setdefault((d_id, off), []).append(r.ids[a:z])
            whole += r.ids
        # every piece of every row, repeated rows and rows without id included
        want = {}
        for i, t in rows:
            ids = tok.encode(t or "").tolist()
            for lo in range(0, len(ids), 128):
                want.setdefault((i, lo), []).append(ids[lo : lo + 128])
        assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
        assert len({(r.shard, r.row_no) for r in packed}) == len(packed)
    empty = docs(spark, [(1, "a", None, None)]).limit(0)
    assert packing.pack(empty).count() == 0 and packing.read_matrix(packing.write_packed(empty)).count() == 0


def test_best_fit_is_tightest():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 65) for _ in range(500)]
    rows = packing.best_fit_decreasing(sizes, 64)
    assert sorted(i for r in rows for i in r) == list(range(500)) and all(sum(sizes[i] for i in r) <= 64 for r in rows)
    room, want = [], 0
    for s in sorted(sizes, reverse=True):
        fit = [r for r in room if r >= s]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - s)
        else:
            want += 1
            room.append(64 - s)
    assert len(rows) == want


def test_matrix_files(spark, tmp_path):
    manifest = packing.write_packed(docs(spark, [(i, "one two three " * 20, "en", "s") for i in range(5)]), f"file://{tmp_path}/m", length=64)
    m = manifest.collect()
    ids = np.concatenate([np.fromfile(f"{tmp_path}/m/ids-{r.shard:05d}.bin", "<u2") for r in m]).reshape(-1, 64)
    reset = np.concatenate([np.fromfile(f"{tmp_path}/m/reset-{r.shard:05d}.bin", "<i4") for r in m])
    packed = packing.read_matrix(manifest).collect()
    assert len(ids) == len(packed) == sum(r.rows for r in m) and sum(r.tokens for r in m) == sum(r.n_tokens for r in packed)
    assert ids.sum() == sum(sum(r.ids) for r in packed) and reset.tolist() == [x for r in packed for x in r.cu_seqlens[:-1]]
    assert sum(r.n_tokens for r in packed) / ids.size > 0.8  # fill rate


def test_warc(spark):
    big = "<html>" + "é" * 100
    rows = [(3, "u3", big), (1, "u1", big), (2, "u\r\n2", big), (4, None, None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (1, "u1", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    members = warc.normalise(warc.write_archives(pages))
    got = warc.read_archives(members).collect()
    view = sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in got)
    same = [(1, 206, "response", None), (1, 206, "response", None), (2, 206, "revisit", 1), (3, 206, "revisit", 1), (None, 206, "response", None)]
    assert view == sorted(map(str, [*same, (4, 0, "response", None), (5, 0, "response", None), (6, 5, "response", None), (7, 5, "response", None)]))
    for r in got:
        want = hashlib.sha256((dict((p, h) for p, _, h in rows)[r.page_id] or "").encode()).hexdigest()
        assert r.payload_digest == want
    assert {r.url for r in got if r.page_id == 2} == {"u\r\n2"}
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.limit(0)))).count() == 0


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_spans():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "@", ".", "1", "25", "+", "-", " ", "é", "(", ")", "4111111111111111", "x@y.z", "10.0.0.1"]) for _ in range(rng.randrange(25)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans(None) == [] and pii.base_spans("9" * 300_000 + " " + "a" * 300_000 + "@") == []


def test_pii_terms(spark):
    rows = [(i, f"filler{i} words mailbox a{i}@b.com more filler", "en", "s") for i in range(30)] + [(100 + i, f"plain words number {i} here more filler", "en", "s") for i in range(100)]
    rows += [(500, None, None, None), (501, "", "en", "s"), (None, "mailbox z@b.com", "en", "s"), (0, rows[0][1], "en", "s")]
    d = docs(spark, rows)
    found = pii.span_digests(pii.find_spans(d, support=5))
    assert {"n_secret", "flagged"} <= set(found.columns)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == 133 and got[3].n_email == 1 and got[3].n_term == 1 and got[100].spans == "" and got[500].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(d, support=5).collect()}
    assert clean[3] == "filler3 words [TERM] [EMAIL] more filler" and clean[500] is None
    assert pii.find_spans(d.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(8)
    alphabets = {"aa": ["ba", "du", "ki", "lo"], "bb": ["sch", "erz", "ung", "eit"], "cc": ["que", "oux", "ais", "ent"]}
    make = lambda k: " ".join("".join(rng.choice(alphabets[k]) for _ in range(3)) for _ in range(30))
    rows = [(i, make(k), k, "s") for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    d = docs(spark, rows + [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "12 !?", "cc", "s"), (903, make("aa") * 300, None, "s"), (None, make("bb"), "bb", None)])
    profiles = language_id.fit(d.where("doc_id < 60"))
    got = {r.doc_id: r for r in language_id.predict(d, profiles, carry=["doc_id"]).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "aa"
    none = language_id.fit(d.limit(0))
    assert {r.lang_pred for r in language_id.predict(d, none).collect()} == {"und"}


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x[500:520] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, [1.0] * 16), (0, x[0].tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = ann.search(e, e.where("vec_id % 50 = 0"), posting_rows=40).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([*range(600), 0])
    u = np.concatenate([u, u[:1]])
    for q in range(0, 600, 50):
        s = u @ u[q]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep].round(12)))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == ids[keep][order].tolist()
        assert np.allclose([r.score for r in mine], s[keep][order])
    assert ann.search(e.limit(0), e.limit(0)).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(e, e.where("vec_id % 50 = 0")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & {r.vec_id for r in got if r.query_id == q})
    assert hits / (5 * 80) >= 0.9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(6)
    rows = [(i, words(rng, 80), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0"), (0, rows[0][1], "en", "s0"), (101, None, "en", "s1"), (102, "12345", "en", None), (103, words(rng, 70), None, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    item = rows[5][1].split()[10:50]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    from sentryflow.staging import staged

    for name, stage in p.STAGES:
        out = staged(stage(spark, d, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == d.columns
        d = out
        seen[name] = out
    ids = lambda n: sorted(r[0] for r in seen[n].select("doc_id").collect())
    assert set(ids("language")) == {r[0] for r in rows} - {101, 102}
    assert ids("near_dedup") == sorted(set(ids("language")) - {100})
    assert ids("decontaminate") == [i for i in ids("near_dedup") if i != 5]
    assert set(ids("mixing")) <= set(ids("decontaminate")) and len(ids("mixing")) > 40
    assert {x for r in seen["packing"].select("doc_ids").collect() for x in r[0]} == set(ids("mixing"))
    assert p.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_pipeline_near_threshold(spark):
    import corpus_pipeline as p

    rng = random.Random(8)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(8)]
    rows = [(i, " ".join(w), "en", "s") for i, w in enumerate(texts)]
    # two words changed: 86 of 106 shingles shared, 0.811; three: 81 of 111, 0.73
    rows += [(100 + i, " ".join("x" if j in (30, 60) else x for j, x in enumerate(w)), "en", "s") for i, w in enumerate(texts)]
    rows += [(200 + i, " ".join("y" if j in (20, 50, 80) else x for j, x in enumerate(w)), "en", "s") for i, w in enumerate(texts)]
    kept = {r.doc_id for r in p.near_duplicates(spark, docs(spark, rows), "").select("doc_id").collect()}
    assert kept == {*range(8), *range(200, 208)}


def test_decontaminate_trimmed_items(spark):
    rng = random.Random(14)
    items = [(i, words(rng, n)) for i, n in enumerate((9, 10, 14, 24, 40, 40, 60))] + [(7, "a b c d e f g h a b c d e f g h a b c d")]
    rows = []
    for i, t in items:
        w = t.split()
        for drop in range(1, 12):
            rows += [(100 * i + drop, " ".join(w[:-drop])), (100 * i + 20 + drop, " ".join(w[drop:])), (100 * i + 40 + drop, " ".join([*w[: -drop - 1], "x"]))]
    rows += [(9000, rows[0][1]), (9000, rows[0][1])]

    def shingles(t):
        w = t.split()
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    want = {}
    for d, t in rows:
        for i, item in items:
            a, b = shingles(t), shingles(item)
            best = max(((k / (2 * len(b) - k), -s) for s in range(len(a) - len(b) + 1) for k in [sum(min(a[s : s + len(b)].count(g), b.count(g)) for g in set(b))]), default=(0, 0))
            if 0 < len(a) < len(b):
                k = sum(min(a.count(g), b.count(g)) for g in set(b))
                best = (k / (len(a) + len(b) - k), 0)
            if best[0] >= 0.8:
                want[d, i] = (-best[1], best[0])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs(spark, [(d, t, "en", "s") for d, t in rows]), bench).collect()
    assert len(got) == len(want) and len(want) > 30
    assert {(r.doc_id, r.item_id): (r.start_shingle, r.similarity) for r in got} == want


def test_pii_terms_of_whole_documents(spark):
    far = "one two three four five six"
    rows = [(i, f"codename {far} a{i}@b.com", "en", "s") for i in range(12)]  # under 20 documents, seven words away
    rows += [(50, f"Codename, {far} codename", "en", "s"), (51, "once only", "en", "s")]  # no base span
    rows += [(100 + i, f"plain {far} words", "en", "s") for i in range(400)] + [(99, "single z@b.com", "en", "s")]
    got = {r.doc_id: r for r in pii.find_spans(docs(spark, rows)).collect()}
    where = {d: [(s.start, s.stop) for s in r.terms] for d, r in got.items() if r.terms}
    assert where == {i: [(0, 8)] for i in range(12)} | {50: [(0, 9), (len(far) + 11, len(far) + 19)]}


def test_pii_passes_and_flushes(spark, monkeypatch):
    rows = [(i, f"secret{i % 3} far from it all, a{i}@b.com secret{i % 3}", "en", "s") for i in range(60)] + [(100 + i, "far from it all", "en", "s") for i in range(300)]
    d = docs(spark, rows)
    want = sorted(map(tuple, pii.span_digests(pii.find_spans(d)).collect()))
    assert sum(r[-2] for r in want) == 120
    monkeypatch.setattr(pii, "HELD", 1)
    monkeypatch.setattr(pii, "COUNTED", 2)
    assert sorted(map(tuple, pii.span_digests(pii.find_spans(d)).collect())) == want


def test_decontaminate_null_id(spark):
    rng = random.Random(15)
    item = words(rng, 30)
    d = docs(spark, [(None, f"{words(rng, 20)} {item}", "en", "s"), (None, " ".join(item.split()[:28]), "en", "s"), (None, words(rng, 40), "en", "s"), (1, words(rng, 40), "en", "s")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.matches(d, bench).collect()
    assert sorted((r.doc_id is None, r.start_shingle) for r in got) == [(True, 0), (True, 20)]
    assert decontaminate.decontaminate(d, bench).count() == 2


def test_near_duplicates_ids_with_several_texts(spark):
    rng = random.Random(21)
    a, b = words(rng, 100), words(rng, 100)
    near = " ".join([*b.split()[:-1], "x"])
    rows = [(2, a), (7, a), (7, b), (9, near), (7, None), (9, ""), (11, None), (12, words(rng, 50)), (None, a), (None, None)]
    got = near_dedup.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    view = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got)
    assert view == sorted([(2, 2, True), *[(7, 2, False)] * 3, (9, 2, False), (9, 2, False), (11, 11, True), (12, 12, True), (0, 0, True), (0, 0, True)])


def test_keep_one_judges_rows(spark, monkeypatch):
    rng = random.Random(22)
    a, b, c = (words(rng, 100) for _ in range(3))
    near = " ".join([*c.split()[:-1], "x"])
    rows = [(3, a), (5, a), (5, b), (5, b), (8, c), (6, near), (None, near), (None, words(rng, 20)), (None, None), (4, ""), (4, "")]
    d = docs(spark, [(i, t, "en", "s") for i, t in rows])
    for limit in (500_000, 0):  # broadcast and shuffle of the members
        monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", limit)
        kept = near_dedup.keep_one(d)
        assert kept.columns == d.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(3, a), (5, b), (6, near), (0, rows[7][1]), (0, ""), (4, ""), (4, "")])
    assert near_dedup.keep_one(d.limit(0)).count() == 0


def test_near_duplicates_chain_of_parts(spark, monkeypatch):
    """Candidates that full sets do not hold together are still compared pair by pair, whatever the block."""
    rng = random.Random(23)
    base = words(rng, 120).split()
    rows = []
    for i in range(40):  # one template, every text with its own words: some pairs over the threshold, most under
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 5)):
            w[at] = f"y{i}_{at}"
        rows.append((i, " ".join(w)))
    want = components(rows)
    for block in (2048, 7):
        monkeypatch.setattr(near_dedup, "LIST_BLOCK", block)
        monkeypatch.setattr(near_dedup, "HUB_SLICE", block)
        got = near_dedup.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 3


def test_mixing_repeats_rows(spark):
    rng = random.Random(24)
    rows = [(None, words(rng, 10), "en", "a") for _ in range(40)] + [(1, "same text here", "en", "b")] * 9 + [(2, words(rng, 30), "en", "b") for _ in range(9)] + [(3, None, None, None)]
    d = docs(spark, rows).withColumn("__row", F.lit(1))
    planned = {}
    for r in mixing.mix(d).collect():
        planned[r.source] = planned.get(r.source, 0) + r.repeats
    out = mixing.repeated(d)
    assert out.columns == d.columns
    got = {}
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + 1
    assert got == {k: v for k, v in planned.items() if v}
    assert {r.text for r in out.collect() if r.source == "a"} == {t for _, t, _, s in rows if s == "a"} or planned["a"] < 40
    first, second = (sorted(r.order for r in mixing.mix(d, seed=s).withColumn("order", F.concat_ws(":", "doc_id", "t", "taken")).select("order").collect()) for s in ("x", "x"))
    assert first == second
    assert mixing.repeated(d.limit(0)).count() == 0


def brute_terms(rows, disclosure=0.8, error=0.01, support=2):
    """Spans of disclosing terms of whole documents, by the definition, from all texts at once."""
    import math

    spans = [pii.protected_spans(t) for _, t in rows]
    holds = [{pii.term_of(m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "") if all(m.end() <= a or m.start() >= z for _, a, z in s)} - {""} for (_, t), s in zip(rows, spans)]
    kinds = [{k for k, _, _ in s} for s in spans]
    n, df, both = len(rows), {}, {}
    for h, ks in zip(holds, kinds):
        for t in h:
            df[t] = df.get(t, 0) + 1
            for k in ks:
                both[t, k] = both.get((t, k), 0) + 1
    bad = set()
    for (t, k), b in both.items():
        p, q = sum(k in ks for ks in kinds) / n, b / df[t]
        if p < 1 and b >= support:
            kl = q * math.log2(q / p) + ((1 - q) * math.log2((1 - q) / (1 - p)) if q < 1 else 0)
            if math.log2(q / p) >= disclosure * -math.log2(p) and df[t] * kl >= math.log2(len(both) / error):
                bad.add(t)
    out = []
    for (i, t), s in zip(rows, spans):
        marks = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "") if all(m.end() <= a or m.start() >= z for _, a, z in s) and pii.term_of(m[0]) in bad]
        out.append((i or 0, ",".join([f"{k}:{a}:{z}" for k, a, z in s] + [f"term:{a}:{z}" for a, z in marks])))
    return sorted(out)


def test_pii_whole_operator_against_brute_force(spark):
    rng = random.Random(31)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"{words(rng, 20, 40)} Mailbox: u{i}@x{i}.org {words(rng, 20, 40)}") for i in range(25)]
    rows += [(100 + i, f"{words(rng, 20, 40)} token = \"{key()}\" {words(rng, 10, 40)}") for i in range(25)]
    rows += [(200 + i, f"{words(rng, 20, 40)} call +49 (30) 1234-56{i:02d} or 10.0.0.{i}") for i in range(15)]
    rows += [(300 + i, words(rng, 30, 40)) for i in range(300)] + [(900, "mailbox alone"), (901, None), (902, ""), (None, "token here"), (0, rows[0][1]), (903, words(rng, 20_000, 40))]
    got = pii.span_digests(pii.find_spans(docs(spark, [(i, t, "en", "s") for i, t in rows]))).collect()
    want = brute_terms(rows)
    assert sorted((r.doc_id or 0, r.spans) for r in got) == want
    assert sum("term:" in s for _, s in want) > 60 and {r.doc_id for r in got if r.n_secret} == set(range(100, 125))
    assert all(r.flagged == bool(r.spans) for r in got)


def test_language_brute_force_prototypes_and_names(spark):
    """Prototypes and scores against the definition, over columns with the operator's own names; repeated rows and ties."""
    rng = random.Random(32)
    rows = [(i, words(rng, 12, 30) if i % 2 else " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(12)), "x" if i % 2 else "y", "s") for i in range(60)]
    rows += [rows[0], rows[1], (70, "solo", None, "s")]
    d = docs(spark, rows).withColumns({c: F.lit("c") for c in ("score", "lang_pred", "__text", "row", "level")})
    dim, bound = 256, 20
    got = language_id.fit(d, per_language=bound, dim=dim)

    def vector(text):
        v, enc = np.zeros(dim), language_id.Encoder(dim)
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        for a, b, c in zip(s, s[1:], s[2:]):
            v += np.roll(enc.letter(ord(a)), 2).astype(float) * np.roll(enc.letter(ord(b)), 1) * enc.letter(ord(c))
        return v / np.linalg.norm(v)

    taken = {}
    for lang in "xy":
        own = d.where(F.col("lang") == lang).select("text", F.xxhash64("doc_id", "text").alias("h")).collect()
        level = [int(np.floor(-16 * np.log2((((r.h % 2**64) >> 11) + 1) / 2**53))) for r in own]
        low = language_id.lowest_level({v: level.count(v) for v in level}, bound)
        taken[lang] = [r.text for r, v in zip(own, level) if v >= low]
        assert 0 < len(taken[lang]) <= bound
    protos = np.stack([s / np.linalg.norm(s) for s in (sum(vector(t) for t in taken[lang]) for lang in "xy")])
    protos -= protos.mean(axis=0)
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    assert got.languages == ["x", "y"] and np.allclose(got.prototypes, protos, atol=1e-5)
    out = language_id.predict(d, got, carry=["doc_id", "text"]).collect()
    assert len(out) == len(rows)
    for r in out:
        sims = protos @ vector(r.text)
        assert r.lang_pred == "xy"[int(sims.argmax())] and abs(r.score - min(1, max(0, sims.max()))) < 1e-5
    assert language_id.lowest_level({3: 5, 1: 9}, 4) is None and language_id.lowest_level({3: 5, 1: 9}, 5) == 3


def test_language_query_holds_out_by_id(spark, tmp_path):
    import zlib

    from sentryflow.llm import queries

    rng = random.Random(33)
    rows = [(i, words(rng, 30), "x", "s") for i in range(80)] + [(None, "abc", "x", "s"), (5, None, None, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_language(spark, str(tmp_path)).collect()
    assert len(got) == 82 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id is not None]
    # a held-out row's label and text do not reach the profiles
    spark.createDataFrame([(i, t, "z" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/b/documents.parquet")
    again = queries.op5_language(spark, f"{tmp_path}/b").collect()
    assert sorted(map(str, held)) == sorted(str((r.doc_id, r.lang_pred, r.score)) for r in again if r.doc_id is not None)


def test_language_filter_keeps_short_texts(spark):
    rng = random.Random(34)
    alphabet = {"aa": ["ba", "du", "ki", "lo"], "bb": ["sch", "erz", "ung", "eit"]}
    make = lambda k, n=30: " ".join("".join(rng.choice(alphabet[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(k), k, "s") for i, k in enumerate(["aa", "bb"] * 30)] + [(900, "Von.", "aa", "s"), (901, None, "aa", "s"), (902, "12 !", "aa", "s"), (903, "жщ " * 100, None, "s"), (None, make("aa"), None, None)]
    d = docs(spark, rows).withColumns({c: F.lit("c") for c in ("score", "lang_pred", "__text", "row")})
    kept = language_id.written_in(d, language_id.fit(d))
    assert kept.columns == d.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([*range(60), 900, -1])
    assert language_id.written_in(d.limit(0), language_id.fit(d)).count() == 0


def brute_matches(rows, items, threshold=0.8):
    """(doc_id, item_id) to (first best window, similarity) by weighted Jaccard similarity of every window."""
    cut = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    want = {}
    for d, t in rows:
        a = grams(cut(t))
        for i, item in items:
            b = grams(cut(item))
            if not b or not a:
                continue
            windows = [(s, a[s : s + len(b)]) for s in range(len(a) - len(b) + 1)] if len(a) >= len(b) else [(0, a)]
            best = max((k / (len(w) + len(b) - k), -s) for s, w in windows for k in [sum(min(w.count(g), b.count(g)) for g in set(b))])
            if best[0] >= threshold:
                want[d, i] = (-best[1], best[0])
    return want


def test_decontaminate_between_threshold_and_one(spark, monkeypatch):
    rng = random.Random(41)
    items = [(i, words(rng, rng.randrange(30, 90))) for i in range(8)] + [(50, "one two three four five six " * 8)]
    rows = []
    for i, t in items:
        for n in range(6):
            w = t.split()
            for at in rng.sample(range(len(w)), n // 2):
                w[at] = f"z{n}"
            if n % 2:
                w.insert(len(w) // 2, "inserted")
            rows.append((100 * i + n, f"{words(rng, 25)} {' '.join(w)} {words(rng, 25)}"))
    rows += [rows[0], (9000, f"{words(rng, 3000)} {items[3][1]} {words(rng, 3000)} {items[4][1]} {items[4][1]}")]
    want = brute_matches(rows, items)
    assert 15 < len(want) < 9 * 7 and sum(0.8 <= s < 1 for _, s in want.values()) > 8
    d, bench = docs(spark, [(i, t, "en", "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")
    for limit, step in ((decontaminate.BROADCAST_BYTES, decontaminate.STEP), (0, 16)):  # broadcast and shuffle; one slice and many
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(decontaminate, "STEP", step)
        got = decontaminate.matches(d, bench).collect()
        assert {(r.doc_id, r.item_id): (r.start_shingle, r.similarity) for r in got} == want and len(got) == len(want)
        assert decontaminate.decontaminate(d, bench).count() == sum(1 for i, _ in rows if i not in {x for x, _ in want})


def test_simhash_of_long_arrays(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, 200, dtype=np.int64)
    x = np.concatenate([np.repeat(x[:1], 70_000), x])  # one bit pattern, more often than 16 bits count
    got = decontaminate.with_simhash(spark.createDataFrame([(x.tolist(), len(x))], "sh array<long>, n int"), "sh", "n", "fp").first().fp
    bits = ((x.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
    want = sum(1 << b for b in range(64) if 2 * int(bits[b]) > len(x))
    assert got % 2**64 == want


def recall(spark, x, **options):
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(e, e.where("vec_id % 50 = 0"), **options).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = asked = 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s, kind="stable")[:5]) & {r.vec_id for r in got if r.query_id == q})
        asked += 5
    return hits / asked


def test_recall_flat_and_clustered(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(6000, 64))
    assert recall(spark, flat, least_rows=0) >= 0.9
    clustered = rng.normal(size=(60, 64)).repeat(100, axis=0) + 0.2 * flat
    assert recall(spark, clustered, least_rows=0, visit=0.08) >= 0.9


def test_neighbours_of_few_rows_and_large_cells(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 7):
        x = rng.normal(size=(n, 8))
        e = spark.createDataFrame([(50 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann.search(e, e, least_rows=0).collect()
        assert len(got) == n * min(5, n - 1)
    # one cell holds a third of the rows; its parts are several postings
    x = rng.normal(size=(900, 8))
    x[:300] = x[0] + 1e-6 * rng.normal(size=(300, 8))
    assert recall(spark, x, posting_rows=32) == 1.0
    counts = np.array([[5, 300], [0, 40]])
    first, parts = ann.postings(counts, 32)
    assert parts.tolist() == [1, 10, 1, 2] and first[0] < first[1] and first[2] >= first[1] + 10 and first[3] > first[2] - 1


def test_neighbours_across_partition_edges(spark):
    rng = random.Random(51)
    keys = [1] * 40 + [2, 3, 3, 4] + [5] * 25 + [rng.randrange(6, 30) for _ in range(60)]
    rows = [(k, rng.randrange(1000), i) for i, k in enumerate(keys)]
    want = sorted((c, at) for k, c, at in rows if keys.count(k) > 1)
    for parts in (1, 2, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            got = repeats.agreeing(spark.createDataFrame(rows, "key long, c long, at long"), "t").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert sorted(map(tuple, got)) == want
    assert repeats.agreeing(spark.createDataFrame([], "key long, c long, at long"), "t").count() == 0


def test_repeated_passages_of_null_ids(spark):
    rng = random.Random(52)
    shared = words(rng, 55)
    rows = [(None, f"{words(rng, 30)} {shared}"), (None, f"{shared} {words(rng, 30)}"), (None, words(rng, 80)), (None, None), (7, ""), (7, f"{words(rng, 10)} {shared}"), (7, words(rng, 70)), (8, f"{shared} {words(rng, 9)} {shared}")]
    got = repeats.repeated_passages(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    view = sorted((r.doc_id or 0, r.n_words, [(x.start, x.stop) for x in r.spans]) for r in got)
    assert view == sorted([(0, 85, [(30, 85)]), (0, 85, [(0, 55)]), (0, 80, []), (0, 0, []), (7, 0, []), (7, 65, [(10, 65)]), (7, 70, []), (8, 119, [(0, 55), (64, 119)])])


def brute_lines(rows):
    cut = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, ls in cut:
        for x in ls:
            if i is not None and len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, ls in cut:
        keep = [x for x in ls if i is None or len(held.get(key(x), ())) < 3 or i == max(held[key(x)])]
        out.append((-1 if i is None else i, "\n".join(keep), len(ls), len(ls) - len(keep)))
    return sorted(out)


def test_line_dedup_hot_and_long(spark):
    rng = random.Random(61)
    common = [f"common line number {i:03d} of all" for i in range(12)]
    rows = [(i, "\n".join(rng.choice([rng.choice(common), common[0], words(rng, 5), f"\t{common[1].upper()} "]) for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    rows += [(500, "\n".join(f"{words(rng, 6)}\n{common[3]}" for _ in range(8000))), (None, common[0]), rows[7], (7, common[0]), (8, None)]
    for hot in (20_000, 5):  # whole keys, and hot ones dealt over parts
        got = line_dedup.line_dedup(docs(spark, [(i, t, "en", "s") for i, t in rows]), batches=5, fanout=2, hot=hot)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows)


def test_runs_are_joined_as_they_lie(spark):
    with line_dedup.sorted_scans(spark):
        a, b = (line_dedup.bucketed(spark.range(500).selectExpr(f"id * {k} as h1", "id as h2", "id as owner", "1L as docs")) for k in (2, 3))
        plan = b.join(a.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan and "SortMergeJoin" in plan


def test_warc_long_pages_and_rollover(spark, tmp_path):
    rng = random.Random(71)
    noise = "".join(chr(rng.randrange(32, 1500)) for _ in range(1 << 20))
    rows = [(1, "u", noise * 5), (2, "u", noise * 5), (3, "u", noise + "\r\n\r\nWARC/1.1\r\n"), (4, None, "")] + [(10 + i, f"u{i}", noise[i * 1000 : i * 1000 + 3000]) for i in range(200)]
    rows += [(10, "again", rows[4][2]), (9, "u", rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc.write_archives(pages, f"file://{tmp_path}/a", archive_bytes=50_000)
    assert archives.count() > 4 and archives.selectExpr("sum(records)").first()[0] == len(rows)
    members = warc.normalise(archives, f"file://{tmp_path}/m")
    import os

    assert not os.path.exists(f"{tmp_path}/a") and all(n.endswith((".warc.gz", ".idx")) for n in os.listdir(f"{tmp_path}/m"))
    got = warc.read_archives(members).collect()
    first = {}
    for p, _, h in rows:
        if len(h.encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = sorted(str((p, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response" if first.get(h, p) == p else "revisit", None if first.get(h, p) == p else first[h])) for p, _, h in rows)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want
    assert sum(r.record_type == "revisit" for r in got) == 2
    # a whole member is read by its place alone
    from sentryflow.llm.files import open_dir

    r = next(x for x in got if x.page_id == 3)
    fs, root = open_dir(f"{tmp_path}/m", create=False)
    with fs.open_input_file(f"{root}/{r.archive}") as f:
        assert warc.read_member(f, r.offset, r.length)["body"].decode() == rows[2][2]


def test_components_with_hubs(spark):
    from sentryflow.llm.components import connected_components

    rng = random.Random(81)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (None, 3), (7000, 6999), (6999, 7000)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    for hub in (1000, 4):
        assert {r.node: r.root for r in connected_components(df, hub=hub).collect()} == {x: find(x) for x in up}
    assert connected_components(df.limit(0)).count() == 0


def test_simhash_is_one_expression(spark):
    """The driver prepares every copy of an expression in a plan."""
    df = decontaminate.with_simhash(spark.createDataFrame([([1], 1)], "sh array<long>, n int"), "sh", "n", "fp")
    plan = df._jdf.queryExecution().optimizedPlan().toJSON()
    assert plan.count("aggregate.") + plan.count("CaseWhen") + plan.count("ArrayAggregate") < 20 and len(plan) < 100_000


def test_components_stop_at_stars(spark, monkeypatch):
    from sentryflow.llm import components

    written = []
    staged = components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: written.append(name) or staged(df, name))
    stars = spark.createDataFrame([(1, 2), (1, 3), (9, 4)], "a long, b long")
    assert {r.node: r.root for r in components.connected_components(stars).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 9: 4}
    assert len(written) == 1
    # 6 and 7 meet in 8 only
    assert {r.root for r in components.connected_components(spark.createDataFrame([(6, 8), (7, 8)], "a long, b long")).collect()} == {6}
    assert len(written) == 3


def test_tokenizer_calls_its_library_once_a_part(monkeypatch):
    import tiktoken

    whole, calls = tiktoken.Encoding.encode_ordinary, []
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or whole(self, text))
    tok = packing.Tokenizer()
    text = " ".join(f"w{i},\nx{i}" for i in range(2000))
    want = whole(tok.encoding, text)
    assert tok.encode(text).tolist() == want and len(calls) == 1
    # cut at spaces only where a token begins
    for part in (1, 2, 7):
        monkeypatch.setattr(packing, "PART", part)
        for t in (text[:500], "a  b \n c\n\n d \t e", " \x1c x\x1d y \x1f", "a \u2003b \u00a0c\u3000 d", "é 12 ½² don't 's 3's ", "   ", "x" * 50, "", "\n \n a\r\n b"):
            assert tok.encode(t).tolist() == whole(tok.encoding, t)
