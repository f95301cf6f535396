"""Every operator against brute force, and on awkward tables: nulls in any
column, empty, blank and very long texts, ties, repeated rows, no rows, and
columns whose names clash with results."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import catalog, preferences, revisits
from clientlens.llm.decontaminate import contaminated, without_contaminated
from clientlens.llm.html_extract import extract, main_text
from clientlens.llm.language_id import predict_language
from clientlens.llm.near_dup import near_duplicates
from clientlens.llm.packing import pack
from clientlens.llm.pretokens import IdLookup, Lookup, _load, read_tokenizer
from clientlens.llm.quality import ORDER, Model, _packed, _tally, quality
from clientlens.llm.suffix_dedup import remove_repeats
from clientlens.llm.token_counts import count_tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, kept string, n_bytes string, sequence_id string, component string, row string, key string"


def awkward_texts():
    rng = random.Random(5)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "épsilon,", "zeta.", "eta", "theta"]) + str(rng.randint(0, 40)) for _ in range(300))
    near = base.split(" ")
    near[100] = "other"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, "word"), (8, "word"), (9, "two words"),
        (10, "x" * 5000), (11, "ab " * 2000), (12, "start " + base + " end"), (None, "nobody's text is here"), (13, "don't <|endoftext|> a\x1cb 中文 Ünïcode ﬁ İ́"),
        (14, "\n".join(["a line of words"] * 30)), (15, " ".join(f"w{i}" for i in range(60_000))), (16, "🙂" * 300), (2, "another text under the same id"),
    ]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None if n % 5 == 4 else "en", "a", "b", "c", "d", "e", None) for n, (i, t) in enumerate(awkward_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- token counts and packing -------------------------------------------------

def library():
    return _load(read_tokenizer(catalog.tokenizer_path()))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_counts_equal_the_library(awkward, docs, nothing):
    tokenizer = library()
    for table in (awkward, docs):
        found = rows_of(count_tokens(table, catalog.tokenizer_path(), table_size=50, per_task=20))
        plain = sorted(((r.doc_id, len((r.text or "").encode()), n := len(ids_of(tokenizer, r.text)), n > 2048) for r in table.collect()), key=str)
        assert found == plain
    assert count_tokens(nothing, catalog.tokenizer_path()).collect() == []


def test_lookups_equal_the_library_on_odd_characters():
    tokenizer, rng = library(), random.Random(2)
    odd = "aZ09 '\t\n\x0b\x0c\r\x1c\x1f\x85\xa0ªµ²ÀßĀİıſƀΣς٣́中🙂<|>endoftext.,!#'s'll're"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["<|endoftext|>", "a<|startoftext|>b", "x" * 300, "'re'S"]
    lengths, ids = Lookup(tokenizer, {}, len, sum), IdLookup(read_tokenizer(catalog.tokenizer_path()))
    for t in texts:
        assert lengths.text(t) == len(ids_of(tokenizer, t)), repr(t)
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in ids.of([t.encode() for t in texts])] == [ids_of(tokenizer, t) for t in texts]


def test_packing_places_every_token_once(awkward, docs, nothing):
    tokenizer = library()
    for table in (awkward, docs):
        found = [r.asDict() for r in pack(table, catalog.tokenizer_path(), block_tokens=40_000).collect()]
        pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
        plain = Counter()
        for r in table.collect():
            ids = [*ids_of(tokenizer, r.text), 1]
            for k, a in enumerate(range(0, len(ids), 4096)):
                part = np.array(ids[a:a + 4096], "<u4")
                plain[r.doc_id, k, a, len(part), zlib.crc32(part)] += 1
        assert pieces == plain
        by_sequence = defaultdict(list)
        for r in found:
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
    assert pack(nothing, catalog.tokenizer_path()).collect() == []


# --- near-duplicates ----------------------------------------------------------

def brute_components(rows, k):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same_id or (sets[i] and sets[j] and 100 * shared >= 80 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), c := low.get(find(i)) if s else d, d == c) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(docs, awkward, nothing, k):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(near_duplicates(docs, k)) == sorted(brute_components(rows, k), key=str)
    rows = [(d, t) for d, t in awkward_texts() if t != "another text under the same id"]
    found = rows_of(near_duplicates(awkward.where("text is null or text <> 'another text under the same id'"), k))
    assert found == sorted(brute_components(rows, k), key=str)
    assert len(near_duplicates(awkward, k).collect()) == len(awkward_texts())
    assert near_duplicates(nothing, k).collect() == []


def test_a_large_family_of_near_copies_keeps_every_link(spark):
    """Copies at the edge of the threshold, a common passage and a hot word pair."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(220, 400):
        rows.append((i, " ".join(base[:30] + [rng.choice(vocabulary) for _ in range(40)])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(near_duplicates(table, 2)) == sorted(brute_components(rows, 2), key=str)


# --- suffix dedup -------------------------------------------------------------

def brute_repeats(rows, length):
    often = Counter(b[i:i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for d, b in rows:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        spans = sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark))
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(docs, awkward, nothing):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert rows_of(remove_repeats(docs).select(*columns)) == brute_repeats(rows, 400)
    small = awkward.where("doc_id is null or doc_id <> 15")
    rows = [(r.doc_id, (r.text or "").encode()) for r in small.collect()]
    out = remove_repeats(small)
    assert rows_of(out.select(*columns)) == brute_repeats(rows, 400)
    assert "kept" in out.columns and out.columns.count("n_bytes") == 1
    assert {r.text for r in out.where("doc_id = 4").collect()} == {None}
    assert remove_repeats(nothing).collect() == []


def test_repeats_of_short_strings_with_hot_passages(spark, monkeypatch):
    """Many partial overlaps; a small block sends some cores to the hash path."""
    from clientlens.llm import suffix_dedup
    rng = random.Random(4)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(700)).decode()
    rows = []
    for i in range(40):
        a, b = sorted(rng.randrange(700) for _ in range(2))
        rows.append((i, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) + passage[a:b] + "".join(rng.choice("abcdefgh") for _ in range(60))))
    rows += [(50, "ab" * 400), (51, "a" * 300), (52, "abc" * 200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = brute_repeats([(d, t.encode()) for d, t in rows], 100)
    for block in (1 << 18, 500):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        found = remove_repeats(table, length=100, gram=16).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert rows_of(found) == plain


# --- quality ------------------------------------------------------------------

def plain_kneser_ney(grams, order):
    """Textbook interpolated modified Kneser-Ney with dictionaries."""
    counts = {order: Counter(grams)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            discounts[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i) for i in (1, 2, 3)]
        else:
            discounts[k] = [0, 0.5, 0.75, 0.9]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        own = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        left = sum(discounts[k][min(n, 3)] for n in own.values())
        n = own.get(g, 0)
        return (n - discounts[k][min(n, 3)]) / total + left / total * p(g[1:])
    return p


def test_model_equals_the_textbook():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab c") for _ in range(60)).strip() for _ in range(6)]
    plain = [" ".join(t.split()) for t in texts]
    p = plain_kneser_ney([tuple(t[i:i + ORDER]) for t in plain for i in range(len(t) - ORDER + 1)], ORDER)
    model = Model(*_tally(_packed(texts)[0]), ORDER)
    for t in [*plain, "abcab", "zzzzz", "cccccc a", "ab zab"]:
        found = np.exp(model.log_p(_packed([t])[0]))
        assert found == pytest.approx([p(tuple(t[i:i + ORDER])) for i in range(len(t) - ORDER + 1)], rel=1e-4)
    total = sum(p(tuple("aab ") + (c,)) for c in "aabc "[1:]) + p(tuple("aab z"))
    assert total <= 1 + 1e-9 and not math.isnan(total)


def test_quality_rejects_junk_and_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    judged = quality(table).join(labels, "doc_id").toPandas()
    usual = judged[~judged.base_failed]
    assert (usual[usual.quality == 1].kept).mean() > 0.99
    assert (usual[usual.quality == 0].kept).mean() < 0.1
    one = quality(table, model_rows=100_000).select("doc_id", "kept")  # a broadcast for each language
    assert rows_of(one.where("kept")) == rows_of(quality(table).select("doc_id", "kept").where("kept"))


def test_quality_of_a_large_language_is_that_of_the_whole_model(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit("xx").alias("lang"))
    table = table.union(table.where("doc_id % 9 = 0")).union(spark.createDataFrame([(-1, None, "xx"), (-2, "abc", "xx"), (-3, "other", "yy")], table.schema))
    columns = ["doc_id", "n_words", "base_failed", "kept", "lang"]
    whole, ranges = (quality(table, model_rows=n).orderBy(*columns).toPandas() for n in (6_000_000, 50_000))
    assert whole[columns].equals(ranges[columns]) and len(whole) == table.count()
    for c in ("log_perplexity", "low", "high"):
        np.testing.assert_allclose(ranges[c], whole[c], rtol=1e-9)


def test_quality_of_awkward_tables(awkward, nothing):
    found = {(r.doc_id, r.n_words): r for r in quality(awkward).collect()}
    assert len(quality(awkward).collect()) == len(awkward_texts())
    assert found[4, 0].base_failed and not found[4, 0].kept and found[4, 0].log_perplexity is None
    assert found[14, 120].n_dup_lines == 29 and found[14, 120].n_repeat_words == 120 and found[14, 120].base_failed
    assert found[15, 60_000].n_repeat_words == 0 and not found[15, 60_000].base_failed
    assert quality(nothing).collect() == []
    tiny = quality(awkward, model_rows=20)  # models of lower orders
    assert len(tiny.collect()) == len(awkward_texts())


# --- language id --------------------------------------------------------------

def test_language_of_held_out_documents(spark, awkward, nothing):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = predict_language(table).join(table.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    assert (found.held_out == found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    out = found[found.held_out & (found.n_chars > 50)]
    assert (out.lang == out.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()
    rows = {(r.doc_id, r.lang_pred, r.score > 0) for r in predict_language(awkward).collect()}
    assert {(4, "und", False), (5, "und", False), (6, "und", False), (16, "und", False)} <= rows
    assert {p for _, p, _ in rows} <= {"und", "en"}
    assert len(predict_language(awkward).collect()) == len(awkward_texts())
    assert predict_language(nothing).collect() == []
    unknown = predict_language(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


# --- decontamination ----------------------------------------------------------

def test_benchmark_passages_are_found_whole_moved_and_changed_in_case(spark, docs, awkward, nothing):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    found = contaminated(docs, benchmark)
    plain = set()
    normal = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    for r in docs.collect():
        plain |= {(r.doc_id, i) for i, t in items.items() if f" {normal(t)} " in f" {normal(r.text)} "}
    assert plain and plain <= {(r.doc_id, r.item_id) for r in found.collect()}
    words = items[0].split()
    half = len(words) // 2
    clean = " ".join(f"c{i}" for i in range(200))
    made = spark.createDataFrame([
        (1, f"{clean} {' '.join(words[half:])} {clean} {' '.join(words[:half])}"), (2, f"{clean} {items[0].upper()}!"), (3, clean),
        (4, " ".join(reversed(words))), (5, None), (6, ""), (6, ""), (None, items[0]), (7, f"{clean} {' '.join(words[:half - 3])}")], "doc_id long, text string")
    hit = {(r.doc_id, r.item_id) for r in contaminated(made, benchmark).collect()}
    assert {(1, 0), (2, 0), (None, 0)} == hit
    assert {r.doc_id for r in without_contaminated(made, benchmark).collect()} == {3, 4, 5, 6, 7, None}
    assert rows_of(contaminated(made, benchmark, block_items=7)) == rows_of(contaminated(made, benchmark))
    odd = spark.createDataFrame([(1, "gamma"), (2, None), (3, "..."), (4, "nobody's text is here"), (4, "word")], "item_id long, text string")
    assert (None, 4) in {(r.doc_id, r.item_id) for r in contaminated(awkward, odd).collect()}
    assert contaminated(nothing, benchmark).collect() == []
    assert contaminated(docs, benchmark.limit(0)).collect() == []


# --- pages --------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{{}}</style></head><body class="has-sidebar">
<header><p>Site header</p></header><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
{open}<h1>Title &amp; {n}</h1><p>First <b>para</b>graph {n}&nbsp;with   spaces.<p>Second &eacute; &#x41;{n}<br>line {n}<div class="ad">Buy!</div>
<form><input name=x>Send <button>ok</button></form><ul><li>one {n}<li>two {n}</ul>{close}
<section id="comments"><article class="comment"><p>A reader says {n}</p></article></section><aside>Related {n}</aside><footer>&copy; {n}</footer></body></html>"""


def test_main_text_of_marked_and_unmarked_pages(spark):
    expected = "Title & {n}\nFirst paragraph {n} with spaces.\nSecond é A{n}\nline {n}\none {n}\ntwo {n}"
    rows = []
    for n in range(8):
        rows.append((n, f"https://a.example.com/{n}", PAGE.format(n=n, open="<article class='post-comments'>", close="</article>")))
        rows.append((100 + n, f"https://b.example.com/{n}", PAGE.format(n=n, open='<div id="main-text">' + f"<p>{f'A longer text about {n}. ' * 9}</p>", close="</div>").replace('class="comment"', "")))
    rows += [(200, "https://c.example.com/", PAGE.format(n=1, open="<main>", close="")), (201, None, "<p>no host"), (202, "https://d.example.com", None), (202, "https://d.example.com", None),
             (203, "nonsense", ""), (204, "https://e.example.com/x", "plain text only"), (None, "https://e.example.com/y", "<div><p>cut < of"),
             (205, "https://f.example.com", "<article>" + "<div>" * 3000 + "deep"), (206, "https://f.example.com", "<article><p>" + "long " * 50_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    out = extract(table)
    found = {r.page_id: r for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(rows)
    for n in range(8):
        assert found[n].text == expected.format(n=n)
        assert found[100 + n].text == (f"A longer text about {n}. " * 9).strip() + "\n" + expected.format(n=n)
        assert found[n].n_chars == len(found[n].text)
    assert found[200].text == expected.format(n=1)
    assert found[201].text == "no host" and found[202].text == "" and found[203].text == "" and found[204].text == "plain text only"
    assert found[205].text == "deep" and found[206].n_chars == 5 * 50_000 - 1
    assert extract(table.limit(0)).collect() == []


def test_main_text_of_the_given_pages_is_their_article(spark):
    import html
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split("<[^>]*>", article)]
        assert found[r.page_id] == "\n".join(b for b in blocks if b)


def test_text_that_every_page_of_a_host_repeats_is_template():
    assert main_text("<article><p>own</p></article>", None, set()) == "own"
    assert main_text("", None, set()) == ""


# --- revisits -----------------------------------------------------------------

def test_revisits_of_awkward_captures(spark):
    rows = [
        (1, "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 10, 200, {"etag": '"1"', "content-length": "5", "server": "s"}, "d1"),
        (2, "https://a.com/x?a=1&b=2", 20, 304, {"etag": 'W/"1"', "content-length": "0", "age": "3"}, None),
        (3, "https://a.com/x?a=1&b=2", 10, 304, {"etag": '"1"'}, None),  # the same moment is not earlier
        (4, "https://a.com/x?a=1&b=2", 30, 200, {"etag": '"2"', "last-modified": "m"}, "d2"),
        (5, "https://a.com/x?a=1&b=2", 30, 404, {"etag": '"3"', "last-modified": "m"}, "d3"),  # a tie: the larger id
        (6, "https://a.com/x?a=1&b=2", 31, 304, {"etag": '"1"'}, None),
        (7, "https://a.com/x?a=1&b=2", 32, 304, {"last-modified": "m"}, None),
        (8, "https://a.com/x?a=1&b=2", 33, 304, None, None),
        (9, None, 5, 304, {}, None), (10, "https://a.com/x?a=1&b=2", None, 304, {}, None), (11, "no host", 9, 304, {}, None), (12, None, 1, 200, {}, "d4"),
        (2, "https://a.com/x?a=1&b=2", 20, 304, {"etag": 'W/"1"', "content-length": "0", "age": "3"}, None), (13, "https://a.com/x?a=1&b=2", 99, None, {}, "d5"),
    ]
    table = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, digest string").withColumn("found", F.lit(1)).withColumn("key", F.lit("k"))
    got = sorted(((r.record_id, r.refers_to, r.outcome, r.status, r.digest, tuple(sorted((r.headers or {}).items()))) for r in revisits.resolve_revisits(table).collect()), key=str)
    one = (2, 1, "resolved", 200, "d1", (("age", "3"), ("content-length", "5"), ("etag", 'W/"1"'), ("server", "s")))
    assert got == sorted([
        one, one, (3, None, "no_response", None, None, ()), (6, 5, "validator_mismatch", None, None, ()),
        (7, 5, "resolved", 404, "d3", (("etag", '"3"'), ("last-modified", "m"))), (8, 5, "resolved", 404, "d3", (("etag", '"3"'), ("last-modified", "m"))),
        (9, None, "no_response", None, None, ()), (10, None, "no_response", None, None, ()), (11, None, "no_response", None, None, ())], key=str)
    assert revisits.resolve_revisits(table.limit(0)).collect() == []


def test_a_hot_url_is_spread_and_still_right(spark):
    many = spark.range(3000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://b.com/"), F.col("id"))).otherwise("http://hot.com/").alias("url"),
                                    F.col("id").alias("ts"), F.when(F.col("id") % 100 == 1, 200).otherwise(304).alias("status"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.lit("d").alias("digest"))
    got = {r.record_id: r.refers_to for r in revisits.resolve_revisits(many).collect()}
    last = None
    for i in range(3000):
        if i % 3 and i % 100 == 1:
            last = i
        elif i % 3:
            assert got[i] == last


# --- preferences --------------------------------------------------------------

def test_preference_pairs_share_their_prefix_once(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (2, 2, "user", None),
        (3, 0, "user", "same"), (4, 0, "user", "same"), (5, 1, None, "b"), (5, None, "system", "a"), (None, 0, "user", "lost"), (6, 0, "assistant", "x"), (6, 0, "assistant", "x"),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("chosen", F.lit(2))
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 4), (2, 5, 6), (3, 7, None)], "pair_id long, chosen long, rejected long")
    r = {x.pair_id: x for x in preferences.preference_examples(table, pairs).collect()}
    mark = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert (r[0].n_prompt_turns, r[0].prompt, r[0].chosen, r[0].rejected) == (1, mark("user", "hi"), mark("assistant", "good"), mark("assistant", "bad") + mark("user", ""))
    assert [r[0].chosen[s.start:s.end] for s in r[0].chosen_spans] == ["good<|im_end|>"]
    assert [r[0].rejected[s.start:s.end] for s in r[0].rejected_spans] == ["bad<|im_end|>"]
    assert (r[1].n_prompt_turns, r[1].chosen, r[1].rejected, r[1].chosen_spans) == (1, "", "", [])
    assert r[2].chosen == mark("system", "a") + mark("user", "b") and len(r[2].rejected_spans) == 2
    assert (r[3].prompt, r[3].chosen, r[3].rejected) == ("", "", "")
    assert preferences.preference_examples(table.limit(0), pairs.limit(0)).collect() == []


def test_preferences_run_no_python(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    plan = preferences.preference_examples(turns, preferences.consecutive_pairs(turns))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


# --- queries and pipeline -----------------------------------------------------

@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    plain = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in plain.description]
    found = catalog.QUERIES[name](spark, SF).select(*names)
    assert rows_of(found) == sorted((tuple(r) for r in plain.fetchall()), key=str)


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(catalog.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path, awkward, nothing):
    import corpus_pipeline as pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    kept = {r.doc_id for r in quality(docs).where("kept").collect()}
    after = pipeline.quality_rules(spark, docs, SF).cache()
    assert ids(after) == kept and after.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in after.collect()]
    near = pipeline.near_dedup(spark, after, SF).cache()
    assert ids(near) == {d for d, _, _, k in brute_components(rows, 5) if k}
    cut = pipeline.suffix_dedup(spark, near, SF).cache()
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()} == {d: h for d, _, _, _, h in brute_repeats([(r.doc_id, r.text.encode()) for r in near.collect()], pipeline.PASSAGE)}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    clean = pipeline.decontamination(spark, cut, SF).cache()
    bad = {r.doc_id for r in contaminated(cut, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(clean) == ids(cut) - bad
    packed = pipeline.best_fit_packing(spark, clean, SF)
    assert ids(packed) == ids(clean)
    assert rows_of(pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32")) == rows_of(packed.select("doc_id", "piece", "length", "ids_crc32"))
    for table in (awkward, nothing):
        now = table
        for n, (_, stage) in enumerate(pipeline.STAGES):
            stage(spark, now, SF).write.parquet(f"{tmp_path}/{id(table)}-{n}")
            now = spark.read.parquet(f"{tmp_path}/{id(table)}-{n}")
        assert (now.count() > 0) == (table is awkward)
    # rows are judged by their text, also where ids are null or repeated
    twice = pipeline.near_dedup(spark, awkward, SF)
    assert [r.text for r in twice.where("doc_id = 2").collect()] == ["another text under the same id"]
    assert twice.where("doc_id = 1").count() == 1 and twice.where("doc_id = 9").count() == 1
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base, "7"), (None, base, "7"), (None, base, "8"), (2, base.replace("word100 ", "other "), "9"), (2, "quite another text of a few words", "9"), (3, "same", "2"), (3, "same", "1")]
    left = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, n_bytes string"), SF)
    assert sorted((r.doc_id, r.text[:5], r.n_bytes) for r in left.collect()) == [(1, "word0", "7"), (2, "quite", "9"), (3, "same", "1")]
    leaked = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = spark.createDataFrame([(None, leaked, "7"), (None, "nothing of the kind", "7"), (4, leaked, "7"), (4, "clean words", "7")], "doc_id long, text string, n_bytes string")
    assert sorted(r.text for r in pipeline.decontamination(spark, rows, SF).collect()) == ["clean words", "nothing of the kind"]
    assert {r.n_bytes for r in pipeline.suffix_dedup(spark, rows, SF).collect()} == {"7"}
