"""The llm operators against brute force, round trips and odd inputs."""

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinlink.llm import chat, common, decontaminate, jaccard, packing, pages, quality, token_counts, toxicity, vafile, warc
from kinlink.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, score double"
ODD = [None, "", " ", "a", "Two  spaces \n and lines\n\n", "ﬁne ①² naïve ÉCOLE it's O'Neil's 12,5% ▁x", "x" * 3000, "<|startoftext|> </s> end", "word " * 5000, "日本語 ΑΣ"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i == 2 else "s", 0.5) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None, None)], DOCS)


def test_token_counts_equal_the_library(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.open_model(path)
    got = Counter(map(tuple, token_counts.count_tokens(odd, path).collect()))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in odd.collect())
    assert got == want
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0
    plain = token_counts.Counter(path)
    plain.whole = None  # as of a model whose premises can't be proved
    texts = [t or "" for t in ODD]
    assert plain(texts) == token_counts.Counter.of(path)(texts)


def test_word_ids_equal_the_library():
    encode = packing.WordEncoder.of(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for t in ODD] + ["".join(chr(p) for p in packing.WordEncoder.POINTS), *(f"a{chr(p)}b {chr(p)}" for p in packing.WordEncoder.POINTS)]
    for _ in range(2):
        ids, length = encode(pa.array([*texts, None]))
        for text, got in zip([*texts, ""], np.split(ids, np.cumsum(length)[:-1]), strict=True):
            assert got.tolist() == encode.whole(text).tolist(), text[:40]
    small = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), room=100)
    for text in texts:  # forgets its words before every text
        assert small(pa.array([text]))[0].tolist() == encode.whole(text).tolist(), text[:40]


def test_packing_is_gapless_and_whole(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path, capacity=64).collect()
    encode = packing.WordEncoder.of(path)
    assert sum(r["length"] for r in rows) == sum(encode(pa.array([r["text"] for r in odd.collect()]))[1] + 1)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_plan_equals_best_fit_over_documents():
    rng = random.Random(3)
    for _ in range(100):
        lengths = sorted((rng.randint(1, 50) for _ in range(rng.randint(0, 80))), reverse=True)
        bins: list[int] = []
        for n in lengths:
            fit = min((b for b in bins if b >= n), default=None)
            if fit is None:
                bins.append(50 - n)
            else:
                bins[bins.index(fit)] = fit - n
        slots, made = packing.plan_counts(Counter(lengths), 50)
        assert made == len(bins) and sum(s[2] for s in slots) == len(lengths)


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(3, "http://a/x y", "same"), (1, None, "same"), (2, "http://b", None), (5, "http://c", long), (5, "http://c", long), (None, "http://n", "same"), (9, "u", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    warc.write(table, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert len(got) == len(rows) and all(r["digest_ok"] for r in got)
    found = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    digest = lambda t: warc.digest((t or "").encode())
    size = len(long.encode())
    assert found == Counter({(1, 4, digest("same"), "response", None): 1, (3, 4, digest("same"), "revisit", 1): 1, (None, 4, digest("same"), "revisit", 1): 1, (2, 0, digest(""), "response", None): 1, (9, 0, digest(""), "revisit", 2): 1, (5, size, digest(long), "response", None): 1, (5, size, digest(long), "revisit", 5): 1})
    assert next(r["payload"] for r in got if r["payload_bytes"] == size and r["payload"]) == long.encode()
    assert warc.unchunk(warc.chunked(long.encode(), 7)) == long.encode()
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))
    warc.write(table.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_pages_keep_articles_and_drop_shared_template(spark):
    marked = "<html><head><title>t</title></head><body><nav>menu</nav><header>top</header><article><header>by</header><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>four<div class='comments'>no</div></article><footer>f</footer>"
    plain = lambda x: f"<body><div>Site of all</div><p>{x}</p><div>Made by us</div><script>var a='<p>no</p>'</script><form>q</form>"
    boxed = lambda x: f"<article><div class='entry-header'><p>{x}</p></div><div class='notice'>Read our rules</div><p>Body {x}</p></article>"
    rows = [(1, "http://h/a/1", plain("first text")), (2, "http://h/a/2", plain("second text")), (3, "http://g/x", marked), (4, None, None), (5, "http://h/a/2", plain("second text")), (6, "http://lone/", plain("alone"))]
    rows += [(7, "http://b/1", boxed("x")), (8, "http://b/2", boxed("y")), (None, "http://b/3", boxed("z")), (9, "http://h/a/2", plain("second text")), (9, "http://h/a/2", plain("second text"))]
    for ranges in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_row", F.lit(1))).collect()}
        assert got[1]["text"] == "first text"
        assert got[2]["text"] == got[5]["text"] == got[9]["text"] == "second text"
        assert got[3]["text"] == "by\nA & B\none two three\nfour"
        assert (got[4]["text"], got[4]["n_chars"]) == ("", 0)
        assert got[6]["text"] == "Site of all\nalone\nMade by us"
        assert (got[7]["text"], got[8]["text"], got[None]["text"]) == ("x\nBody x", "y\nBody y", "z\nBody z")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("html", "text"), [
    ("<article><div class='entry-header'><h1>Title</h1></div><p>Body</p></article>", "Title\nBody"),
    ("<form action='x'><div><article><p>Body</p><form>q</form></article></div><p>no</p></form>", "Body"),
    ("<article><p>Body</p></article><section><h2>More</h2><article class='teaser'><p>Next</p></article></section>", "Body"),
    ("<article><p class='lead share'>Lead</p><figure><img><figcaption>Fig</figcaption></figure><p>Body <math><mi>x</mi></math></p></article>", "Lead\nFig\nBody x"),
    ("<article><h2 id='side-effects'>Side</h2><section id='related-work'><p>Work</p></section><article class='comment'>Hi</article><div class='ad'>Buy</div></article>", "Side\nWork"),
    ("<article class='teaser'><p>Only</p></article>", "Only"),
    ("<div>" * 30000 + "deep" + "</div>" * 30000, "deep"),
    ("<p>a<script>x</p>", "a"),
])
def test_lines_of_a_page(html, text):
    assert "\n".join(t for _, t in pages.candidates(html)) == text


def test_pages_against_brute_force(spark):
    """Every page against the nearest other content of its host, found by looking at all of them."""
    rng = random.Random(8)
    rows = []
    for i in range(120):
        host = rng.choice(["h", "h", "h", "g", "k"])
        body = rng.sample([f"line {k}" for k in range(14)], rng.randint(1, 5)) if rng.random() < 0.8 else ["copy", "of all"]
        tag = "article" if rng.random() < 0.2 else "div"
        rows.append((i, f"http://{host}/{rng.randrange(3)}/{rng.randrange(9)}/{i % 40}", f"<p>Top of {host}</p><{tag}>" + "".join(f"<p>{x}</p>" for x in body) + f"</{tag}><p>End</p>"))
    lines = {i: pages.candidates(html) for i, _, html in rows}
    order = sorted(rows, key=lambda r: (*pages.address(r[1]), r[0]))
    want = {}
    for k, (i, url, _) in enumerate(order):
        host, path = pages.address(url)
        texts = [t for _, t in lines[i]]
        near = [next(((j, u) for j, u, _ in side if pages.address(u)[0] == host and [t for _, t in lines[j]] != texts), None) for side in (order[:k][::-1], order[k + 1 :])]
        near = [(2 * len(os.path.commonprefix((path, pages.address(x[1])[1]))) + 1 - n, x[0]) for n, x in enumerate(near) if x]
        kept = texts
        if near:
            shared = set(pages.shared_places(texts, [t for _, t in lines[max(near)[1]]]))
            kept = [t for n, (s, t) in enumerate(lines[i]) if s == pages.ARTICLE or n not in shared] or texts
        want[i] = "\n".join(kept)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_shared_places_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pages.TABLE_BITS = rng.choice([1, 8, 1 << 27])
        places, rest = pages.shared_places(a, b), iter(b)
        assert len(places) == table[-1][-1] and all(a[i] in rest for i in places)


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_jaccard_classes_equal_brute_force(spark):
    rng = random.Random(5)
    texts: list[str | None] = [None, "", "", "?!", "one two", "One, two!", "a " * 50]
    for _ in range(12):
        base = prose(rng, rng.randint(8, 120))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(frame, jaccard.Settings(block_rows=3)).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {t or ""})
    root, links = list(range(len(texts))), [0] * len(texts)
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n * 1000 >= 800 * (len(a) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == {i: (root[i], links[i]) for i in range(len(texts))}
    assert jaccard.classes(frame.limit(0)).count() == 0


def test_jaccard_of_an_id_with_two_texts(spark):
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, words("w", 40)), (1, words("x", 40)), (2, words("w", 39)), (3, words("x", 39)), (3, words("x", 39)), (4, words("y", 40))]
    got = Counter(map(tuple, jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == Counter({(1, 1, 1): 1, (1, 1, 2): 1, (2, 1, 1): 1, (3, 1, 2): 2, (4, 4, 0): 1})


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_intermediate_tables_go_when_asked(spark):
    common.materialise(spark.range(3), "some")
    assert os.listdir(common.session_dir(spark))
    common.clear(spark)
    assert not os.path.exists(common.session_dir(spark))


def test_leaks_find_copies_and_paraphrases(spark):
    rng = random.Random(9)
    items = [" ".join(prose(rng, 30)) + ". " + " ".join(prose(rng, 8)) + "." for _ in range(20)]
    rows = [(i, " ".join(prose(rng, 400))) for i in range(60)] + [(90, None), (91, "")]
    for k in range(10):
        words = items[k].split()
        if k >= 5:
            for at in range(3, len(words) - 10, 6):
                words[at] = "other"
        rows.append((100 + k, " ".join([*prose(rng, 150), *words, *prose(rng, 150)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(100 + k, k) for k in range(10)}
    assert decontaminate.keep_clean(docs, bench).count() == len(rows) - 10
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 == decontaminate.leaks(docs, bench.limit(0)).count()


def test_latent_search_recalls_paraphrases(spark):
    """Of items with a fifth of the words replaced, planted in running text, the cosine search alone finds nine tenths."""
    rng = random.Random(21)
    text = lambda n: [f"w{int(400 * rng.random() ** 2)}" for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(20, 60))) + ". " + " ".join(text(8))) for i in range(60)]
    rows = [(1000 + i, " ".join(text(600))) for i in range(100)]
    for i, item in items:
        words = [rng.choice(text(1)) if rng.random() < 0.2 else w for w in item.split()]
        rows.append((i, " ".join([*text(rng.randint(0, 200)), *words, *text(rng.randint(0, 200))])))
    some = decontaminate.read_items(items)
    encoded = decontaminate.materialise(decontaminate.encode(spark.createDataFrame(rows, "doc_id long, text string"), some), "ids")
    s = decontaminate.Settings()
    idf, basis = decontaminate.latent_space(encoded, len(some.vocabulary), s)
    found = {(r["doc_id"], some.item_id[r["item"]]) for r in decontaminate.search(encoded, some, idf, basis, s).collect()}
    assert sum((i, i) in found for i, _ in items) >= 0.9 * len(items)
    rows_of = [decontaminate.np.bincount(ids, minlength=len(idf)) * idf for _, t in rows for k in range(0, len(t.split()), 64) for ids in [[some.vocabulary.get(w, 0) for w in decontaminate.WORD.findall(t)[k : k + 64]]]]
    value = np.linalg.svd(np.array(rows_of), compute_uv=False)[: s.rank]

    assert np.linalg.norm(np.array(rows_of) @ basis) ** 2 > 0.85 * (value**2).sum()


def test_leaks_find_copies_beside_repeated_words(spark):
    """Repeats of other items' words and lines turn a passage's vector away from the item it holds."""
    rng = random.Random(12)
    items = [" ".join(prose(rng, 30)) + ". " + " ".join(prose(rng, 8)) + "." for _ in range(200)]
    rows = []
    for k in range(20):
        line = " ".join(items[100 + k].split()[:6]) + "\n"
        around = (items[50 + k].split()[0] + " ") * 100 if k % 2 else line * 20
        shuffled = items[k].split()
        rng.shuffle(shuffled)
        rows += [(k, f"{around}\n{items[k]}\n{around}"), (100 + k, f"{around}\n{' '.join(shuffled)}\n{around}"), (200 + k, around * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(20)}


def test_toxicity_learns_misspellings(spark):
    rng = random.Random(2)
    common = [f"{a}{b}" for a in ("the", "wor", "lan", "mir", "tol", "ped") for b in ("a", "ing", "ed", "or", "ly", "es", "an")]
    clean = lambda n: [rng.choice(common) for _ in range(n)]
    rows, labels = [], []
    for i in range(800):
        words = clean(rng.randint(5, 90))
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["stupid", "stupidd", "worthless", "idiotic"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, " ".join([*clean(30), "stupiid", *clean(30)])), (1001, " ".join(clean(60))), (1002, None), (1003, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert got[1000] > 0.3 > got[1001] and got[1002] == got[1003] and 0 <= got[1002] <= 1
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_quality_shrinks_sparse_sites(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = " ".join(["junk"] * 40) if bad else " ".join(prose(rng, 60))
        rows.append((i, text, "en", None if i % 50 == 0 else f"s{i % 2}", 1.0))
        labels.append((i, int(not bad)))
    rows += [(900, None, None, "tiny", 0.0), (901, " ".join(prose(rng, 60)), "en", "tiny", 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(rows) and all(got[i]["keep"] == (i % 3 != 0) for i in range(300)) and got[901]["keep"]
    kept = quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in got.values())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(0, 0.2, (300, 8))
    data[50:120] = data[7]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, [1e6] * 8), (404, [0.5] * 3), (405, []), (420, []), (440, [1e7] * 8), (441, [-1e7] * 8)]
    vectors = vafile.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, vafile.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()))
    ints = {r["vec_id"]: [int(x) for x in r["v"]] for r in vectors.collect()}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        scored = sorted((-min(max(sum(a * b for a, b in zip(ints[q], v, strict=True)), vafile.LOW), vafile.HIGH), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:20]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert vafile.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_a_query_whose_id_repeats(spark):
    """30 rows of the query's own id and of high score take no places of others, in many small ranges too."""
    rng = np.random.default_rng(2)
    exact = np.floor(rng.normal(0, 12, (200, 8)))
    exact[:30] = 60
    rows = [(7 if i < 30 else i, v.tolist(), "x") for i, v in enumerate(exact)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>, rid string")
    want = sorted((-int(exact[i] @ exact[0]), i) for i in range(30, 200))[:20]
    for n in (1, 9):
        got = sorted(map(tuple, vafile.top_k(vectors.repartition(n), vectors.where("vec_id = 7"), 20).collect()))
        assert got == [(7, r, i, -s) for r, (s, i) in enumerate(want, 1)]


def test_cells_bound_scores_and_spare_reads(spark):
    rng = np.random.default_rng(5)
    exact = np.floor(rng.normal(0, 9, (3000, 32)))
    cells = np.floor(exact / (1 << vafile.CELL_BITS)).astype(np.int8)
    rest = np.linalg.norm(exact - (1 << vafile.CELL_BITS) * cells - 0.5, axis=1)
    search = vafile.Scan(np.arange(20), exact[:20], 20)
    for at in range(0, 3000, 700):
        search.block(np.arange(3000)[at : at + 700], np.arange(3000)[at : at + 700], cells[at : at + 700], rest[at : at + 700])
    reads = 0
    for query, (rid, _, low, upper) in search.candidates():
        true = exact[rid] @ exact[query]
        assert (low <= true).all() and (true <= upper).all()
        others = [i for i in np.lexsort((np.arange(3000), -(exact @ exact[query]))) if i != query][:20]
        assert set(others) <= set(rid.tolist())
        reads += len(rid)
    assert reads < 0.25 * 20 * 3000


def test_transcripts_recover_roles(spark):
    rng = random.Random(6)
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(prose(rng, 8 if t % 2 == 0 else 40)) + "\n" + " ".join(prose(rng, 5))) for c in range(60) for t in range(4)]
    quoted = "First line\nQ: what?\nA: see below"
    rows += [(70, 0, None, None), (None, 0, "user", "hi"), (None, 0, "user", "hi"), (71, 0, "user", "<|im_end|> x"), (72, 0, "user", "ask"), (72, 1, "assistant", quoted), (72, 2, "tool", "42"), (72, 3, "critic", "no"), (73, 0, "user", "x" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("held_out", F.lit(True))
    got = chat.parse(frame, chat.fit(frame)).collect()
    assert len(got) == 66 and np.mean([r["agreement"] for r in got if r["held_out"]]) > 0.9
    assert "<| im_end|> x" in next(r["rendered"] for r in got if r["conv_id"] == 71)
    mixed = next(r for r in got if r["conv_id"] == 72)
    assert "<|im_start|>critic\nno<|im_end|>" in mixed["rendered"] and "<|im_start|>tool\n42<|im_end|>" in mixed["rendered"]
    assert chat.parse(frame.limit(0), chat.fit(frame)).count() == 0


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        model = chat.Model(rng.integers(0, 9, chat.STATES + chat.STATES**2 + chat.STATES * chat.OFFSETS[-1]).astype(float))
        lines = [str(rng.choice(["User: hi", "", "what?", "Bot: x", "### Human: y", "So it is."])) for _ in range(4)]
        emitted = model.emit[:, chat.features(lines)].sum(2)
        value = lambda path: model.first[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:])) + sum(emitted[x, i] for i, x in enumerate(path))  # noqa: B023, B905, E731
        assert value(model.viterbi(lines)) == pytest.approx(max(map(value, itertools.product(range(chat.STATES), repeat=len(lines)))))


def test_pages_of_articles_are_differenced_too(spark):
    page = lambda x: f"<article><p>Top</p><p>{x}</p></article>"
    rows = spark.createDataFrame([(1, "http://h/1", page("a")), (2, "http://h/2", page("b")), (3, "http://h/3", "")], "page_id long, url string, html string")
    lines = pages.materialise(pages.page_lines(rows), "lines")
    assert [r["_shared"] for r in pages.template(lines).collect()] == [[0], [0]]
    assert {r["page_id"]: r["text"] for r in pages.extract(rows).collect()} == {1: "Top\na", 2: "Top\nb", 3: ""}


def test_texts_of_pages_that_keep_all_lines_are_not_shuffled(spark):
    """All pages are aligned; where shared lines stay as an article vouches for them, the texts only meet a small table."""
    html = [(i, f"http://h/a/{i}", f"<article><p>Top</p><p>line {i}</p></article>") for i in range(9)]
    made = pages.extract(spark.createDataFrame(html, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in made.collect()} == {i: f"Top\nline {i}" for i in range(9)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
