"""Toxicity, url filters, archives, exact top-k and the pipeline against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rankspark import session
from rankspark.llm import exact_topk, toxicity, url_filters, warc

# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    bad, clean = ["loser", "moron", "scum"], [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(clean, k=rng.randint(5, 60))
        toxic = int(i % 4 == 0)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs += [(9001, ""), (9002, None), (None, "loser moron"), (9003, "word1 " * 20_000), (9003, "word1")]
    labels += [(0, None), (None, 1), (1, 7), (9001, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    scored = model.score(docs.withColumn("features", F.lit("kept"))).withColumn("out", toxicity.held_out()).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.features == "kept" for r in scored)
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    held = [r for r in scored if r.out and r.doc_id < 600]
    assert sum((r.score >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    scores = {r.doc_id: r.score for r in scored}
    assert scores[9001] < 0.3 and scores[9002] == scores[9001] and scores[9003] < 0.3 and scores[None] > 0.3


def test_held_out_labels_are_not_read(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{(r.doc_id, r.text): r.score for r in toxicity.fit(docs, x).score(docs).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_without_labels_or_documents(labelled, empty):
    docs, labels = labelled
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in none.score(docs).select("score").collect()} == {0.0}
    assert toxicity.fit(empty, labels).score(empty).count() == 0
    with pytest.raises(ValueError):
        none.score(docs.withColumn("Score", F.lit(1)))


def test_features_look_at_the_text_alone():
    words = {"=idiot": 5.0, "lowe": 4.0}
    plain, near = toxicity.features("nothing to see", words), toxicity.features("You idiot! SHOUTED lowered soooo s*it", words)
    assert len(plain) == len(near) == toxicity.FEATURES
    assert plain[:11] == [0.0] * 11 and all(near[i] > 0 for i in (0, 1, 3, 5, 7, 9, 10, 12, 13, 16, 17))


# ---------------------------------------------------------------- urls

URLS = [
    (1, "http://A.Example.com/en/1?x#y"), (2, "https://www.example.com/en/2"), (3, "http://shop.org/es/x#1"), (4, None), (5, "no scheme/en/"),
    (6, "http://b.net/es/7"), (7, "http://b.net"), (8, "x://y.net/fr/://z"), (9, "http://notexample.com/en/1"), (10, "://c.NET/fr/"),
    (11, "http://example.com?en/"), (11, "http://example.com?en/"), (None, "http://ünï.net/es/\nq"), (12, ""), (13, "http://net/es/"),
    (14, "http://e.com.evil.org/"), (15, "http:///en/"),
]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in url_filters.RULES if host and f".{host}".endswith(f".{h}") and path.startswith(p)]
    return host, path, *(max(fits, key=lambda r: len(r[0])) if fits else (None, None))


def test_url_rules(spark):
    got = url_filters.judged(spark.createDataFrame(URLS, "page_id long, url string"), url_filters.RULES).collect()
    rows = Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got)
    assert rows == Counter((i, *plain_rule(u)) for i, u in URLS)
    assert {r.verdict for r in got} <= {"allow", "block"}


def test_url_templates(spark):
    pages = [(i, f"http://a.net/es/list/{w}/{i}") for i, w in enumerate(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=60))]
    pages += [(100 + i, f"http://a.net/{x}/list/q/{i}") for i in range(20) for x in ("fr", "en")]
    # No rule fits /en/ on a.net; what it means on b.com, where a rule allows it, decides.
    pages += [(200 + i, f"http://b.com/en/list/q/{i}") for i in range(20)]
    got = {r.page_id: r for r in url_filters.judged(spark.createDataFrame(pages, "page_id long, url string"), url_filters.RULES).collect()}
    assert got[0].template.startswith("a.net/+/") and got[0].purity > 0.9
    assert {r.verdict for r in got.values() if "/en/" in r.path} == {"allow"}


def test_url_templates_reject_what_lies_among_blocked_pages(spark):
    """Names that vary make a wildcard; pages in it that no rule fits go with the labelled ones."""
    pages = [(i, f"http://h.org/{'bad' if i % 10 else 'x'}{chr(97 + i % 26)}{chr(97 + i // 26)}/p") for i in range(100)]
    got = url_filters.judged(spark.createDataFrame(pages, "page_id long, url string"), [("h.org", "/bad", "block")]).collect()
    assert {r.template for r in got} == {"h.org/*/p"} and {r.verdict for r in got} == {"block"}


def test_urls_of_nothing(spark):
    assert url_filters.judged(spark.createDataFrame([], "page_id long, url string"), url_filters.RULES).count() == 0


# ---------------------------------------------------------------- archives


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("<p>abc é</p>\r\n", k=n))
    same, other = text(3000), text(1500)
    rows = [(i, f"http://h/{i}", f"<html>{i}{text(800)}</html>") for i in range(40)]
    rows += [(50, "u", same), (51, "u\r\nWARC-Type: x", same), (52, None, same), (60, "%0A", other), (60, "again", other), (61, "a", "short"), (62, "b", "short")]
    rows += [(70, "n", None), (71, "e", ""), (None, "x", same), (None, "y", "of no id"), (80, "long", text(200_000)), (81, "é" * 10, "é" * 999)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))


def test_archives(spark, pages):
    rows, frame = pages
    path = session.new_path(spark, "archives")
    warc.write_archives(frame, path, archive_bytes=60_000)
    got = warc.read_archives(spark, path).collect()
    largest = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 1000:
            largest[html] = max(largest.get(html, -1), -1 if i is None else i)
    want = Counter()
    for i, url, html in rows:
        data = (html or "").encode()
        first = largest.get(html, i)
        revisit = html in largest and (-1 if i is None else i) != first
        want[i, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) > 1
    for f in files:  # plain readers can do it too: a dictionary frame leads, each record is a frame
        assert bytes(f.content[:4]) == warc.DICTIONARY_MAGIC.to_bytes(4, "little")


def test_archives_of_nothing(spark):
    path = session.new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_damaged_records_are_refused():
    good = warc.record(1, "u", b"payload", None, False)
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload\r", b"payloae\r"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X"),
                re.sub(rb"Content-Length: (\d+)\r\nWARC", b"Content-Length: 9\r\nWARC", good)):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    assert list(warc.read_frames(warc.EMPTY_FRAME + frame + warc.EMPTY_FRAME)) == [good]
    for bad in (frame[:-3], b"\0" * 20, frame + warc.dictionary_frame(b"x" * 100)):
        with pytest.raises(ValueError):
            list(warc.read_frames(bad))


# ---------------------------------------------------------------- top-k


def plain_top_k(rows, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            own = [int(np.floor(64 * float(x))) for x in v]
            ints[i] = min(ints.get(i, own), own)
    out = set()
    for q, v in ints.items():
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ints.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("n, head", [(500, 4096), (500, 30), (7, 4096)])
def test_exact_top_k(spark, monkeypatch, n, head):
    for name, value in (("HEAD", head), ("RUN", 3), ("LEADING", 3)):
        monkeypatch.setattr(exact_topk, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(n)]
    rows += [(1000, [0.0] * 8), (1001, None), (1002, [1.0, None]), (1003, [float("nan")] * 8), (1004, [float("inf")]), (None, [1.0] * 8)]
    rows += [(1020, [1.0, 2.0]), (1005, []), (3, [9.0] * 8), (1006, rows[1][1]), (1007, rows[1][1]), (1040, [-5.0] * 8)]
    vectors = session.materialise(exact_topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "vectors")
    got = exact_topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), block=40, group=5)
    assert {tuple(r) for r in got.collect()} == plain_top_k(rows, 20)


def test_top_k_of_nothing(spark):
    vectors = exact_topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert exact_topk.top_k(vectors, vectors).count() == 0


# ---------------------------------------------------------------- pipeline


def test_stages_and_columns(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram jaccard join", "best-fit packing"]
    assert "pipeline" in entry.queries() and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if re.match(r"op\d", q)}


def test_stages_keep_clean_and_odd_rows(spark, small, odd, odd_rows):
    kept = corpus_pipeline.toxicity_stage(spark, odd.withColumn("score", F.lit(1)), small)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == len(odd_rows)
    lines = corpus_pipeline.line_stage(spark, odd.withColumn("n_lines", F.lit(1)), small)
    assert lines.columns == corpus_pipeline.COLUMNS and lines.count() == len(odd_rows)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = corpus_pipeline.near_duplicate_stage(spark, odd, small)
    ids = Counter(r.doc_id for r in near.collect())
    assert near.columns == corpus_pipeline.COLUMNS
    # 13 to 17 are near copies of 12; 21, and the null id's first text, repeat others; 25 is 24 in capitals.
    assert {12, 20, 22, 23, 24, 26, 27, 28, 29, 30} <= set(ids) and not {21, 25} & set(ids) and ids[30] == 1 and ids[None] == 2
    assert corpus_pipeline.packing_stage(spark, odd, small).count() >= len(odd_rows)


def test_stages_on_nothing(spark, small, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
        docs = empty


def test_run_applies_the_stages_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = session.materialise(stage(spark, docs, small), "stage")
    got = corpus_pipeline.run(spark, small)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got.select(key).collect())) == Counter(map(tuple, docs.select(key).collect()))


def test_top_k_when_exchanges_have_more_partitions_than_asked(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    for name in ("repartition", "repartitionByRange"):
        plain = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda df, n, *columns, plain=plain: plain(df, max(n, 16) if columns and isinstance(n, int) else n, *columns))
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.1, 3)).tolist()) for i in range(600)]
    vectors = session.materialise(exact_topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vectors")
    got = exact_topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), block=16, group=4).collect()
    assert len(got) == 600 and {tuple(r) for r in got} == plain_top_k(rows, 20)


def five_word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_groups(rows):
    """Group number of each row (doc_id, text) by the links of five-word shingles at 0.8."""
    sets, parent = [five_word_sets(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i] == rows[j] or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_near_duplicate_stage_drops_linked_rows_only(spark, odd, odd_rows, small):
    extra = [(0, "an unlike text that shares an id with another", "en", "s", 1), (0, "and one more of that id", "en", "s", 1), (30, "x y", "en", "s0", 3)]
    rows = [*odd_rows, *extra]
    docs = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, small).collect()]
    plain = [(r[0], r[1]) for r in rows]
    groups = plain_groups(plain)
    assert len(kept) == len(set(kept)) == len(set(groups)) and set(kept) <= set(plain)
    by_group = {}
    for g, r in zip(groups, plain, strict=True):
        by_group.setdefault(g, set()).add(r)
    for own in by_group.values():
        (one,) = own & set(kept)
        ids = [i for i, _ in own if i is not None]
        assert one[0] == (min(ids) if ids else None)


def test_run_is_the_stages_in_plain_python(spark, small, tmp_path):
    """run() on a small table against the stages restated: scores of the model, then lines, links and pieces in plain Python."""
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = [(r.doc_id, r.text or "") for r in model.score(docs).collect() if r.score < toxicity.THRESHOLD]
    space = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(space))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, set()).add(i)
    gone = {k: max(ids) for k, ids in held.items() if len(ids) >= 5}
    rows = [(i, "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i)) for i, t in rows]
    groups = plain_groups(rows)
    least = {}
    for g, r in zip(groups, rows, strict=True):
        least[g] = min(least.get(g, r), r)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in least.values():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for n, s in enumerate(range(0, len(ids), 2048)):
            want[i, n, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def plain_templates(paths):
    """{(host, path): (template, purity)} level by level in plain Python. paths: {(host, segments): [n, labelled, blocked]}."""
    at = {key: ("", "") for key in paths}
    for level in range(max((len(s) for _, s in paths), default=0)):
        nodes = {}
        for (host, segments), counts in paths.items():
            if level < len(segments):
                child = nodes.setdefault((host, at[host, segments][0]), {}).setdefault(segments[level], [0, 0, 0])
                for i in range(3):
                    child[i] += counts[i]
        moved = dict(at)
        for (host, segments) in paths:
            if level >= len(segments):
                continue
            branch, plain = at[host, segments]
            children = nodes[host, branch]
            n, labelled, blocked = (sum(c[i] for c in children.values()) for i in range(3))
            own = children[segments[level]]
            alike, rest = False, labelled - own[1]
            if own[1] and rest:
                share = blocked / labelled
                error = (share * (1 - share) * (1 / own[1] + 1 / rest)) ** 0.5
                alike = abs(own[2] / own[1] - (blocked - own[2]) / rest) <= url_filters.ALIKE_Z * error
            variable = len(children) >= url_filters.VARIABLE_CHILDREN and len(children) >= url_filters.VARIABLE_SHARE * n
            moved[host, segments] = (
                f"{branch}/{'*' if variable else '+' if alike else segments[level]}", f"{plain}/{'*' if variable else segments[level]}")
        at = moved
    prior = url_filters.PRIOR
    total = [sum(c[i] for c in paths.values()) for i in range(3)]
    share = total[2] / total[1] if total[1] else 0.0
    over, own, first = {}, {}, {}
    for (host, segments), counts in paths.items():
        branch, plain = at[host, segments]
        for store, key in ((over, plain), (own, (host, branch))):
            sums = store.setdefault(key, [0, 0])
            sums[0] += counts[1]
            sums[1] += counts[2]
        first[host, branch] = min(first.get((host, branch), plain), plain)
    out = {}
    for host, segments in paths:
        branch = at[host, segments][0]
        labelled, blocked = over[first[host, branch]]
        back = (blocked + prior * share) / (labelled + prior)
        labelled, blocked = own[host, branch]
        out[host, segments] = (host + branch, (blocked + prior * back) / (labelled + prior))
    return out


def test_url_tree_to_the_end_of_the_paths(spark):
    rng = random.Random(12)
    urls = []
    for i in range(600):
        depth = rng.choice([0, 1, 2, 3, 4, 5, 6, 9])
        parts = [rng.choice(["fr", "es", "en", "list", f"v{rng.randrange(40)}", "a" * 20, str(rng.randrange(9)), ""]) for _ in range(depth)]
        urls.append((i, f"https://{rng.choice(['x.net', 'y.net', 'z.org', 'shop.com'])}/" + "/".join(parts)))
    urls += [(700 + i, "http://deep.org/" + "/".join(["s"] * 4000 + [str("ab"[i % 2])] * 3000)) for i in range(6)]
    urls += [(800 + i, f"http://{h}/fr/only") for i, h in enumerate(["x.net"] * 30 + ["z.org"])]
    frame = spark.createDataFrame(urls, "page_id long, url string").withColumns({"host": F.lit("other"), "label": F.lit(1), "template": F.lit("t")})
    got = url_filters.judged(frame, url_filters.RULES).collect()
    assert len(got) == len(urls)
    paths, of = {}, {}
    for i, url in urls:
        host, path, rule, verdict = plain_rule(url) if len(plain_rule(url)) == 4 else (*plain_rule(url), None)
        segments = tuple(
            "$" if re.fullmatch("[0-9a-fA-F-]{16,}", s) else re.sub("[0-9]+", "#", s) for s in re.sub("^/", "", path).split("/"))
        of[i] = (host, segments)
        counts = paths.setdefault((host, segments), [0, 0, 0])
        counts[0] += 1
        counts[1] += rule is not None
        counts[2] += verdict == "block"
    want = plain_templates(paths)
    for r in got:
        template, purity = want[of[r.page_id]]
        assert r.template == template and r.purity == pytest.approx(purity)
        assert r.rule is not None or r.verdict == ("block" if purity >= url_filters.REJECT else "allow")
    unruled = [r for r in got if r.rule is None]
    assert {r.verdict for r in unruled} == {"allow", "block"}
