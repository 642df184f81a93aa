"""The text operators on hard cases, against brute force, exact round trips and held-out accuracy."""

import gzip
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cadenza.llm.decontaminate import contaminated
from cadenza.llm.html_text import extract_main_text, main_text
from cadenza.llm.language_id import identify
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.ngram_join import jaccard_components
from cadenza.llm.pieces import Transducer, decode_documents, encode_documents
from cadenza.llm.queries import MODEL, URL_RULES
from cadenza.llm.topk import top_k
from cadenza.llm.toxicity import score_documents, without_toxic
from cadenza.llm.url_filter import filter_urls
from cadenza.llm.warc import archive_round_trip, salvage

D = "/root/testdata/sf0.001"
#: Columns that clash with names the operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, sig long, comp long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in texts], SCHEMA)


HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "x " * 30_000), (6, "é ☃ 123"), (7, "one")]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join_is_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 40, 90]))] for _ in range(8)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    rows = list(enumerate(texts, 10)) + [(i, t) for i, t in HARD if i != 4]
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = {i: shingles(t) for i, t in rows}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(spark, docs(spark, rows)).collect()}
    assert got == {(i, len(s), find(i)) for i, s in sets.items()}


def test_hard_texts(spark):
    x = docs(spark, HARD)
    labels = spark.createDataFrame([(1, None), (4, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    assert jaccard_components(spark, x).count() == len(HARD)
    assert identify(spark, x).filter("doc_id in (1, 2, 3)").select("lang_pred").distinct().first()[0] == "und"
    assert score_documents(spark, x, labels).filter("score between 0 and 1").count() == len(HARD)
    assert without_toxic(spark, x, labels).columns == x.columns
    out = {r["doc_id"]: r["text"] for r in dedup_lines(spark, x).collect()}
    assert out[1] is None and out[2] == "" and out[4] == "one" and out[7] == "" and out[3] == " \n\t "
    assert encode_documents(spark, x, MODEL).filter("round_trip or doc_id = 1").count() == len(HARD)
    assert contaminated(spark, x, spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")).count() == 0


def test_empty_tables(spark):
    x = docs(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (jaccard_components(spark, x), identify(spark, x), score_documents(spark, x, labels), dedup_lines(spark, x), encode_documents(spark, x, MODEL), extract_main_text(pages), filter_urls(spark, pages, URL_RULES),
                contaminated(spark, x, x.select(F.col("doc_id").alias("item_id"), "text")), top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0)):
        assert out.count() == 0


def test_fuzzy_lines(spark):
    """Equal normalised lines always go; one word in 60 changed flips few bits of the SimHash, mostly few enough for the blocks. No unlike line goes."""
    rng = random.Random(2)
    lines = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    changed = [[*x[:30], "other", *x[31:]] for x in lines]
    x = docs(spark, [(1, "\n".join(map(" ".join, lines)) + "\nHello, World!"), (2, "\n".join(map(" ".join, changed))), (3, "hello world\nother text altogether here")])
    out = {r["doc_id"]: r["text"] for r in dedup_lines(spark, x).collect()}
    assert out[1].count("\n") == 40 and out[3] == "other text altogether here"
    assert len(out[2].split("\n")) <= 20


def test_one_changed_word_is_found_in_lines_of_any_length(spark):
    rng = random.Random(4)
    texts, unlike = {}, ["yes", "something that is not like any of the others"]
    for words in (3, 6, 10, 27, 60, 150):
        lines = [[f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(10**4)}" for _ in range(words)] for _ in range(20)]
        at = words // 2
        swapped = [[*x[:at], x[at][:-1] + "x" if words < 6 else "other", *x[at + 1 :]] for x in lines]
        longer = [[*x[:at], "an" if words > 3 else "a", *x[at:]] for x in lines]
        texts |= {1000 * k + words: "\n".join(map(" ".join, x)) for k, x in enumerate((lines, swapped, longer))}
    x = docs(spark, [*texts.items(), (9000, "\n".join(unlike))])
    out = {r["doc_id"]: [y for y in r["text"].split("\n") if y] for r in dedup_lines(spark, x).collect()}
    assert out.pop(9000) == unlike
    assert {i: len(y) for i, y in out.items()} == {i: 20 if i < 1000 else 0 for i in texts}


def test_pieces_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    other, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), Transducer.load(MODEL)
    for t in ["", " a  b\nc", "Thntou  the\nedorth é ☃ 123", " " * 41, "the" * 300, "日本語 한국어 𝔘", "x" + " " * 37]:
        assert own.encode(t) == other.encode(t)
        assert own.decode(own.encode(t)) == t


def test_pieces_round_trip(spark):
    x = spark.read.parquet(f"{D}/documents.parquet")
    back = decode_documents(spark, encode_documents(spark, x, MODEL), MODEL)
    assert back.join(x.withColumnRenamed("text", "was"), "doc_id").filter("text <> was").count() == 0


def test_held_out_accuracy(spark):
    x = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(spark, x).join(x.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    tox = score_documents(spark, x, labels).join(labels, "doc_id").filter("held_out")
    assert tox.filter("toxic = 0").agg(F.avg("predicted")).first()[0] < 0.05
    assert tox.filter("toxic = 1").agg(F.avg("predicted")).first()[0] > 0.6


def test_more_than_64_languages_are_learned(spark):
    names = [f"{a}{b}" for a in "abcdefg" for b in "abcdefghij"]
    rows = [(10 * k + i, " ".join([x * 3] * 5), x) for k, x in enumerate(names) for i in range(10)]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: x for i, _, x in rows}


def test_main_text():
    page = "<html><head><title>T</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Ti&amp;tle</h1><p><b>one <i>two</i><br><p>three</p><div class=comments>no</div></article><footer>f</footer>"
    assert main_text(page) == "Ti&tle\n\none two\n\nthree"
    assert main_text(None) == main_text("") == main_text("<p><a href=x>only links here</a>") == ""
    assert main_text("<nav>menu<article><p>text &lt;b&gt;</article>") == "text <b>"
    assert main_text('<script>if (a<b) x = "</script><p>it is 1 < 2 and <a title=it\'s href="a>b">here</a> too') == "it is 1 < 2 and here too"


def test_windows_decide_without_an_article():
    """A surge keeps what lies between its dives, short lines too; a shorter block between other dives goes."""
    menu, long = "<p><a href=x>links</a></p>", "word " * 20
    page = f"{menu}<p>aside</p>{menu}<h1>Title</h1><p>by</p><p>me</p><p>now</p><p>{long}</p><p>end</p>{menu}<p>left</p>{menu}"
    assert main_text(page) == "\n\n".join(["Title", "by", "me", "now", long.strip(), "end"])


@pytest.mark.parametrize("part", ["<a ", "<nav><script>", '<a b="', "<a 'x' ", "</", "<!--", '<a "x>', "<style>", "< "])
def test_broken_markup_takes_linear_time(part):
    import time

    begin = time.process_time()
    main_text(part * (2_000_000 // len(part)))
    assert time.process_time() - begin < 20


def test_pages_with_gaps_repeats_and_other_columns(spark):
    page = "<article><p>one</p><p>two</p></article>"
    x = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page * 3, "x"), (2, "v", None, "x"), (3, "w", "", "x")], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in extract_main_text(x).collect()))
    assert got == [(0, "", "\n\n".join(["one", "two"] * 3), 28), (1, "u", "one\n\ntwo", 8), (1, "u", "one\n\ntwo", 8), (2, "v", "", 0), (3, "w", "", 0)]


def test_warc(spark):
    long = "<p>" + "é" * 100
    rows = [(3, "http://a\r\nx", long), (1, "b", long), (2, "c", "short"), (4, None, "short"), (5, "d", None)]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archive_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (203, "response", None), 3: (203, "revisit", 1), 2: (5, "response", None), 4: (5, "response", None), 5: (0, "response", None)}


def record(page, payload):
    import hashlib

    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_salvage(pack):
    parts = [pack(record(i, b"payload %d" % i)) for i in range(4)]
    bad = bytearray(parts[1])
    bad[len(bad) // 2] ^= 0xFF
    data = parts[0] + bytes(bad) + b"junk" + parts[2] + parts[3][:-9]
    got = list(salvage(data))
    assert [r.get("page_id") for r in got] == [0, None, 2, None] and sum(r["length"] for r in got) == len(data)


@pytest.mark.parametrize("before", [b"junk", b""])
def test_salvage_after_a_broken_beginning(before):
    parts = [gzip.compress(record(i, b"payload %d" % i)) for i in range(3)]
    data = before + b"\x00\x00" + parts[0][2:] + parts[1] + record(7, b"plain \x1f\x8b\x08") + parts[2]
    got = list(salvage(data))
    assert [r.get("page_id") for r in got] == [None, 1, 7, 2] and sum(r["length"] for r in got) == len(data)


def test_warc_keeps_rows_without_an_id(spark):
    long = "<p>" + "x" * 100
    rows = [(None, "a", long), (1, "b", long), (2, "c", long), (None, "d", "short")]
    got = archive_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str) == [(0, 103, "response", None), (0, 5, "response", None), (1, 103, "response", None), (2, 103, "revisit", 1)]


def test_url_rules(spark):
    urls = ["http://A.com/en/1", "https://x.example.com/en/7x?q", "http://example.net/de/8/", "http://b.net/de/8", "ftp://c.org", "http://notcom/en/", None, "nothing", "http://z.org?/es/"]
    x = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(spark, x, URL_RULES).orderBy("page_id").collect()]
    assert got == [("a.com", "/en/1", "com/en/", "block"), ("x.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.net", "/de/8/", "example.net/de/8", "block"), ("b.net", "/de/8", "net/de/", "allow"),
                   ("c.org", "", None, "allow"), ("notcom", "/en/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("z.org", "", None, "allow")]


def test_top_k_with_ties_and_gaps(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(4)]) for i in range(200)] + [(300, None), (301, [None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 4), (0, None), (20, [0.5, 0.5, 0.5, float("inf")])]
    own = {i: [int(v * 64 // 1) for v in x] for i, x in rows[:200]}
    want = set()
    for q in own:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(own[q], own[c], strict=True)), c) for c in own if c != q)[:20]
            want |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    got = top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0)
    assert {tuple(r) for r in got.collect()} == want


def test_top_k_of_null_ids_repeats_widths_and_clashing_columns(spark):
    rows = [(None, [9.0, 9.0]), (None, None), (20, [1.0]), (40, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [4.0, 4.0]), (2, [3.0]), (3, [-1.0]), (4, []), (5, [0.25, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, id long, query long, v string")
    got = {tuple(r) for r in top_k(spark, df, lambda i: i % 20 == 0).collect()}
    assert got == {(20, 1, 2, 64 * 192), (20, 2, 3, -64 * 64), (40, 1, 1, 32 * 64 + 32 * 128), (40, 2, 5, 16 * 64)}
    assert top_k(spark, df.limit(0), lambda i: i % 20 == 0).collect() == []
    with pytest.raises(ValueError):
        top_k(spark, spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"), lambda i: i % 20 == 0)


def test_short_and_numeric_items_are_found_by_their_values(spark):
    rng = random.Random(6)
    numbers = lambda n: " ".join(str(rng.randrange(1000)) for _ in range(n))
    items = ["42", "Yes", "it", "7 km", "Name three primes"] + [numbers(30) for _ in range(30)]
    texts = ["I paid 7 coins", "yes it rains in Rome", "42", "yes", "We drove 7 km", "7 km", "He said name three primes to me"] + [numbers(60) for _ in range(20)] + [f"{numbers(10)} {items[8]} {numbers(10)}"]
    found = contaminated(spark, docs(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(2, 0), (3, 1), (5, 3), (6, 4), (27, 8)}


def test_leaks_and_reparameterised_leaks(spark):
    item = "A train of Alpha Lines covers 120 km in 3 hours while a second train covers 80 km in 4 hours, which of them is faster and by how much overall"
    again = item.replace("120", "555").replace("80", "70").replace("3 hours", "9 hours").replace("4 hours", "2 hours")
    mixed = re.sub(r"\bsecond train covers 80\b", "second bus took 80", item)
    x = docs(spark, [(1, "Before. " + item + ". After."), (2, again), (3, "nothing of the kind is here at all, only words"), (4, mixed[: len(mixed) // 2])])
    assert {r["doc_id"] for r in contaminated(spark, x, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()} == {1, 2}


def test_leaks_of_repeated_windows_of_one_template_and_of_short_items(spark):
    items = ["Add 3, 5, 7, 9, 11, 13, 15, 17 and 19 together", "A farmer has 12 cows and buys 7 more, how many cows does he have now?", "A farmer has 31 cows and buys 4 more, how many cows does he have now?", "Name three primes"]
    again = items[1].replace("12", "80").replace("7", "6")
    texts = ["Before. " + items[0] + ". After that, more.", f"First: {items[1]} Then: {again}", f"{items[1]}\n{items[2]}", "He said: name three primes, please, and then more", items[0].replace("9,", "well 9,"), "Add 3, 5, 7 and 9 to something else"]
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["consistency"] for r in contaminated(spark, docs(spark, list(enumerate(texts, 1))), bench).collect()}
    assert {(1, 1), (2, 2), (3, 2), (3, 3), (4, 4)} <= set(got) and not any(i == 6 for i, _ in got)
    assert got[1, 1] == got[2, 2] == got[3, 2] == got[3, 3] == got[4, 4] == 1.0


def test_pipeline_keeps_its_stages_decisions(spark):
    import corpus_pipeline as P

    x = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, x, D)
        assert out.columns == x.columns
    assert P.run(spark, D).filter("not round_trip").count() == 0
