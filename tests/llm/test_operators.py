"""Each corpus operator against a brute-force version on small inputs, with the awkward rows of its contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, carried int"


def prose(seed, n, names=("the", "of", "stone", "river", "and", "walks", "blue", "Étage", "no.", "tree", "hill", "go", "Where", "it")):
    r = random.Random(seed)
    return " ".join(r.choice(names) + (str(r.randrange(900)) if r.random() < 0.7 else "") for _ in range(n))


def texts():
    base = prose(1, 300)
    w = base.split()
    near = [" ".join(w[:k] + ["changed"] + w[k + 1 :]) for k in range(5, 290, 12)]
    passage = "\n".join(prose(100 + k, 20) for k in range(4))
    out = [base, base, base.upper(), *near, prose(2, 80), prose(3, 120) + "\n" + passage + "\n" + prose(4, 30), prose(5, 60) + "\n" + passage, "", None, "   \n\t", "one", "one two", "ONE two", "a b c", "spam eggs ham " * 60]
    out += [prose(200 + k, 55) for k in range(25)] + ["same line here\n" * 40 + prose(6, 70), prose(7, 60) + " *** $$$ ### " * 40, prose(8, 20000), "x" * 20000, "two  blanks \n\n end <|endoftext|> x"]
    out += [passage, passage.replace("\n", "\n\n")]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k, t, ("en", "de", None)[k % 3], (None, "hot", "hot", "s1", "s2")[k % 5]) for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def test_wavelet_round_trip(spark, tmp_path, docs, empty, rows, vocabulary, library):
    from weftline.llm.wavelet import open_shards, read_documents, token_counts, write_shards

    shards = write_shards(docs, vocabulary, end_id=2, shard_tokens=3000)
    got = {r["doc_id"]: r for r in read_documents(shards).collect()}
    start, total = 0, 0
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), doc
        start += len(ids)
        total += ids.count(262)
    assert shards.count() > 3
    assert token_counts(shards, 262).agg(F.sum("n")).first()[0] == total
    assert write_shards(empty, vocabulary).count() == 0
    write_shards(docs, vocabulary, end_id=2, shard_tokens=3000, output=f"{tmp_path}/shards")
    assert {r["doc_id"]: r for r in read_documents(open_shards(spark, f"{tmp_path}/shards")).collect()} == got


def test_wavelet_access_rank_select():
    from weftline.llm.wavelet import Shard, build

    r = np.random.default_rng(3)
    ids = np.minimum(r.zipf(1.4, 7000), 50000).astype(np.uint16)
    shard = Shard(build(ids, [5, None], [3000, 4000]))
    assert (shard.tokens() == ids).all() and shard.doc_ids == [5, None]
    for at in [0, 1, 2047, 2048, 6999, *r.integers(0, 7000, 40)]:
        assert shard.access(int(at)) == ids[at]
    for token in [1, 2, 17, int(ids[77]), 60000]:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.rank(token, 3500) == (places < 3500).sum()
        for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert shard.select(token, k) == places[k]
    with pytest.raises(IndexError):
        shard.select(60000, 0)


def test_mixing(spark, docs, empty, rows):
    from weftline.llm.mixing import mix, with_copies

    got = with_copies(docs).collect()
    sizes, sources = {r[0]: len(brute.words(r[1])) for r in rows}, {}
    for r in rows:
        sources[r[3]] = sources.get(r[3], 0) + sizes[r[0]]
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(sources.values())
    while True:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * sources[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sources[s]
            left -= target[s]
        open_ -= over
    target |= {s: share * weight[s] for s in open_}
    for r in got:
        assert r["mix_size"] == sizes[r["doc_id"]] and r["mix_source_size"] == sources[r["source"]]
        assert r["mix_target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["mix_copies"] <= 2
    again = {(r["doc_id"], r["mix_copies"]) for r in with_copies(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["mix_copies"]) for r in got}
    assert mix(docs).count() == sum(r["mix_copies"] for r in got)
    assert mix(docs).columns == docs.columns
    assert with_copies(empty).count() == 0


CLASHES = "q__rest int, mix_source string, mix_rate double, mix_size string, mix_copies int, gone_id int, gone_row int, gone_pos int, row string, line int, b int, `a.b` map<string,int>"


def test_names_that_clash(spark):
    """Columns of an operator's own names and of any type come back as they were, once per row; null ids are rows like others."""
    from weftline.llm.decontaminate import uncontaminated
    from weftline.llm.line_dedup import dedup_lines
    from weftline.llm.mixing import mix, with_copies
    from weftline.llm.ngram_join import one_of_each
    from weftline.llm.outliers import passing

    own = (1, "m", 0.5, "s", 7, 2, 3, 4, "r", 5, 6, {"k": 1})
    ids = [1, 1, 2, None, None, 3]
    data = [(i, prose(20 + k, 60), "en", "s", *own) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, {CLASHES}")
    benchmark = spark.createDataFrame([(1, "no such words at all")], "item_id long, text string")
    for out, n in ((mix(docs), None), (one_of_each(docs), 5), (passing(docs), 6), (uncontaminated(docs, benchmark), 6)):
        rows = out.collect()
        assert out.columns == docs.columns and {str(tuple(r)[4:]) for r in rows} == {str(own)} and len(rows) == (n or len(rows))
    sized = with_copies(docs)
    assert sized.columns == [c for c in docs.columns if c not in ("mix_size", "mix_copies")] + ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    assert {r["mix_size"] for r in sized.collect()} == {60} and len(mix(docs).collect()) == sum(r["mix_copies"] for r in sized.collect())
    lines = dedup_lines(docs)
    assert {(r["row"], r["gone_row"], r["gone_pos"], r["line"], str(r["a.b"])) for r in lines.collect()} == {("r", 3, 4, 5, "{'k': 1}")} and lines.count() == 6
    many = spark.createDataFrame([(None, f"w{k} x", "s") for k in range(400)] + [(k, "y", "t") for k in range(400)], "doc_id long, text string, source string")
    assert len({r["mix_copies"] for r in with_copies(many).filter("source = 's'").collect()}) == 2


def test_toxicity_against_plain_python(spark):
    """Entries, exceptions, features and scores are those of plain counting and searching, and the curve is the ridge optimum."""
    import math

    from weftline.llm import toxicity as X

    r = random.Random(9)
    mild = ["river", "stone", "walks", "tree", "hill", "grüße", "Étage"]
    rude = ["idiot", "ID10T", "1diot", "scumbag", "scumbags", "ѕcumbag", "sсum\u200bbag!", "$cumbag", "moron5", "m0rons"]
    rows = [(k, " ".join([r.choice(mild) for _ in range(r.randrange(3, 30))] + ([r.choice(rude) for _ in range(r.randrange(1, 4))] if k % 3 == 0 else [])), int(k % 3 == 0)) for k in range(240)]
    rows += [(300 + k, "a scumbag proof lock on the hill", 0) for k in range(9)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "12 !! ??"), (903, "x" * 50000)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(5, None), (None, 1), (900, 1)], "doc_id long, toxic int")
    found = X.learn(docs, labels)
    weights, exceptions = brute.lexicon([(t, y) for _, t, y in rows])
    assert weights and exceptions and found.weights == pytest.approx(weights) and set(found.exceptions) == exceptions
    signs = "aeiou ab 0123456789@$!€._-ѕ\u200bÉ漢²"
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randrange(12)))
        assert X.folded(text) == brute.fold(text), repr(text)
    x = np.array([(1.0, *brute.lexicon_features(t, weights, exceptions)) for _, t, _ in rows])
    curve, y = np.array(found.curve), np.array([y for *_, y in rows])
    p = 1 / (1 + np.exp(-x @ curve))
    assert np.abs(x.T @ (y - p) - np.array([1e-6, 0.5, 0.5, 0.5]) * curve).max() < 1e-4
    scores = {s["doc_id"]: s["tox_score"] for s in X.score_texts(docs, found).collect()}
    for (k, *_), z in zip(rows, x @ curve, strict=True):
        assert scores[k] == pytest.approx(1 / (1 + math.exp(-z)))
    assert [scores[k] for k in (900, 901, 902, 903)] == pytest.approx([1 / (1 + math.exp(-curve[0]))] * 4) and scores[900] < 0.3
    assert X.learn(docs, labels.limit(0)).weights == {} and X.score_texts(docs.limit(0), found).count() == 0


def test_warc(spark):
    from weftline.llm.warc import derived_records, rendered, responses_from_pages

    html = "<html lang='de'><title>T &amp; x</title><body><script>no()</script><p>Hi <b>you</b>&amp;me</p><!-- c --><a href='/x'>l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a", html), (2, None, None), (3, "http://c", ""), (1, "http://a", html)], "page_id long, url string, html string")
    got = derived_records(responses_from_pages(pages)).collect()
    assert len(got) == 8
    one = {r["warc_type"]: r for r in got if r["source_id"] == 1}
    assert one["conversion"]["block"] == "Hi you&me\nl"
    assert one["metadata"]["block"] == "title: T & x\r\nlanguage: de\r\noutlinks: 1\r\n"
    assert one["metadata"]["refers_to"] == one["conversion"]["refers_to"] != one["conversion"]["record_id"]
    assert one["conversion"]["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    empty = [r for r in got if r["source_id"] == 2 and r["warc_type"] == "conversion"][0]
    assert empty["block"] == "" and empty["target_uri"] is None and empty["content_length"] == 0
    text = rendered(derived_records(responses_from_pages(pages.filter("page_id = 1")))).first()["record"]
    assert text.startswith("WARC/1.1\r\nWARC-Type: ") and "WARC-Refers-To: <urn:uuid:" in text
    assert derived_records(responses_from_pages(pages.limit(0))).count() == 0


def test_warc_references_and_headers(spark):
    from weftline.llm.warc import derived_records, rendered

    html = "<p>&copy; 2024 &middot; caf&eacute; it&#8217;s &#xE9;&#x1F600; a&nbsp;b&#160;c &amp;copy; &notaname; &hellip;&#10;x &AMP;&copy</p><p>AT&T &NotEqualTilde;</p>"
    headers = "HTTP/1.1 203 Other\r\nServer: x\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n"
    source = spark.createDataFrame([(1, "<r>", "http://a", "2024-01-01T00:00:00Z", headers, html)], "source_id long, record_id string, target_uri string, date string, http_headers string, payload string")
    records = derived_records(source)
    got = {r["warc_type"]: r for r in records.collect()}
    assert got["conversion"]["block"] == "\u00a9 2024 \u00b7 caf\u00e9 it\u2019s \u00e9\U0001f600 a b c &copy; \u00acaname; \u2026 x &\u00a9\nAT&T \u2242\u0338"
    assert got["metadata"]["http_headers"] == got["conversion"]["http_headers"] == headers
    for r in rendered(records).collect():
        head = r["record"].split("\r\n\r\n")[0].split("\r\n")
        assert [x[25:] for x in head if x.startswith("WARC-Source-HTTP-Header: ")] == ["HTTP/1.1 203 Other", "Server: x", "Content-Type: text/html", "Set-Cookie: a=1", "Set-Cookie: b=2"]


def test_warc_against_a_parser(spark):
    """Random pages, the given ones and awkward ones have the text, title, language and links that the standard library's parser finds."""
    from weftline.llm.warc import derived_records, read_page, responses_from_pages

    r = random.Random(8)
    parts = ["<p>", "</p>", "<div class='a > b'>", "</div>", "<b>", "</b>", "<br/>", "<a href=x>", '<A title="1>0" HREF="/y">', "</a>", "<script>if (a < b) { '<p>' }</script>", "<style>p{}</style >", "<!-- <p>no</p> -->", "<!DOCTYPE html>", "<title>T&eacute; x</title>", "<html lang='De-AT'>", "<noscript>gone</noscript>", "&copy;", "&#8217;", "&#xE9", "&amp;lt;", "&nbsp;", "&bogus;", " word ", "a<1", "\n\t", "é", "<li>", "<h2>", "<pre>", "<img src='q'>", "<template>t</template>"]
    pages = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(300)]
    pages += ["<p>open<script>never closed", "<title>never closed", "<p>x<style>", "", "<p" + "y" * 5000 + ">z", "long " * 30000]
    given = [x["html"] for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    source = spark.createDataFrame(list(enumerate(pages + given)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = {(x["source_id"], x["warc_type"]): x["block"] for x in derived_records(responses_from_pages(source)).collect()}
    for k, page in enumerate(pages + given):
        text, title, lang, links = brute.page(page)
        assert got[k, "conversion"] == text, page
        assert got[k, "metadata"] == f"title: {title}\r\nlanguage: {lang}\r\noutlinks: {links}\r\n", page
    assert read_page("a<!-- never closed")[0] == "a" and read_page("<p title='x>y")[0] == "y" and read_page(None) == ("", "", "", 0)
    assert not any("&copy;" in got[k + len(pages), "conversion"] for k in range(len(given)))


def test_warc_files(spark, tmp_path):
    """Records that are written and read back are what was written."""
    from weftline.llm.warc import derived_records, read_records, responses_from_pages, write_records

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(spark.createDataFrame([(900, None, None), (901, "http://x", "<p>é &amp;<p>two")], "page_id long, url string, html string"))
    records = derived_records(responses_from_pages(pages))
    write_records(records.repartition(3), f"{tmp_path}/warc")
    back = read_records(spark, f"{tmp_path}/warc")
    rows = lambda df: sorted((tuple(x) for x in df.select(*back.columns).collect()), key=repr)
    assert rows(back) == rows(records) and back.count() == 2 * pages.count()


def check_join(spark, docs, rows):
    from weftline.llm.ngram_join import join_components

    want = brute.components([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join_components(docs).collect()}
    assert got == want


def test_join(spark, docs, rows, empty):
    from weftline.llm.ngram_join import join_components, one_of_each

    check_join(spark, docs, rows)
    want = {c for _, c in brute.components([(r[0], r[1]) for r in rows]).values()}
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    twice = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "a b c", "en", "s", "x", 1)], SCHEMA))
    ids = [r["doc_id"] for r in one_of_each(twice).collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert [r["component_id"] for r in join_components(twice).filter("doc_id IS NULL").collect()] == [None]
    assert join_components(empty).count() == 0


def test_join_in_blocks_and_long_lists(spark, monkeypatch):
    """A big group of near copies, dealt over many small blocks, with all lists long."""
    from weftline.llm import ngram_join

    for name, value in (("BLOCK_SETS", 12), ("SHORT_LIST", 3), ("FREQUENT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(5)
    base = prose(9, 220).split()
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.randrange(40)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, prose(300 + k // 3, 60) + f" tail{k}") for k in range(30)]
    check_join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_signatures_meet():
    """Random sets at the threshold share as many signatures as demanded, in every class of tokens."""
    from weftline.llm.ngram_join import PERCENT, least_linkable, signatures

    r = np.random.default_rng(11)
    for _ in range(300):
        n = int(r.integers(least_linkable(), 400))
        x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        drop = int(r.integers(0, n // 10 + 1))
        y = np.unique(np.r_[x[r.permutation(len(x))[drop:]], r.integers(0, 1 << 62, int(r.integers(0, 3))).astype(np.uint64)])
        shared = len(np.intersect1d(x, y))
        if 100 * shared < PERCENT * (len(x) + len(y) - shared):
            continue
        rate = float(r.random())
        levels = {int(t): 1 + int(r.integers(0, 5)) for t in np.union1d(x, y) if r.random() < rate}
        (a, la), (b, lb) = signatures(x, levels, len(x), True), signatures(y, levels, len(y), True)
        assert len(np.intersect1d(a, b)) >= min(la, lb) >= 1


def test_line_dedup(docs, rows, empty):
    from weftline.llm.line_dedup import dedup_lines

    gone = brute.deleted_lines([(r[0], r[1]) for r in rows])
    for r in dedup_lines(docs).collect():
        lines = (r["text"] or "").split("\n")
        held = [k for k, x in enumerate(lines) if brute.words(x)]
        out = {held[k] for k in gone.get(r["doc_id"], ())}
        assert r["n_deleted"] == len(out) and r["n_lines"] == len(held)
        assert r["dedup_text"] == (None if r["text"] is None else "\n".join(x for k, x in enumerate(lines) if k not in out))
    assert dedup_lines(empty).count() == 0


def test_line_dedup_random(spark):
    from weftline.llm.line_dedup import dedup_lines

    r = random.Random(8)
    rows = [(k, "\n".join(r.choice(["a b", "c d e", "f", "g h i j"]) + f" {r.randrange(3)}" for _ in range(r.randrange(1, 14)))) for k in range(40)]
    gone = brute.deleted_lines(rows, 9)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 9).collect()
    assert {r["doc_id"]: r["n_deleted"] for r in got} == {k: len(gone.get(k, ())) for k, _ in rows}


@pytest.mark.parametrize("seed", range(2))
def test_suffix_array_against_a_plain_one(spark, seed):
    """Order, neighbours' common prefixes and maximal runs are those of sorted lists of lines."""
    from weftline.llm import line_dedup as D

    r = random.Random(seed)
    texts = ["\n".join(r.choice("abc") + (f" {k}{j}" if r.random() < 0.1 else "") for j in range(r.randrange(1, 40))) for k in range(12)]
    texts += [texts[0], "a\n" * 30, "b\na\n" * 9]
    docs = spark.createDataFrame([(k, 7 - k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string").repartition(3)
    lines = D.numbered_lines(docs)
    own = {(x["row"], x["line"]): (x["id_a"], x["id_b"]) for x in lines.collect()}
    times = {}
    for i in own.values():
        times[i] = times.get(i, 0) + 1
    suffixes = {}
    for row, line in own:
        end = line
        while (row, end) in own and times[own[row, end]] > 1:
            end += 1
        if end > line:
            suffixes[row, line] = [own[row, x] for x in range(line, end)]
    order = sorted(suffixes, key=lambda at: (suffixes[at], 7 - at[0], at))
    level = D.prefix_doubling(lines)
    placed = D.suffix_array(level)
    assert [(x["row"], x["line"]) for x in placed.orderBy("place").collect()] == order
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for least in (1, 4):
        want = {}
        for a, b in zip(order, order[1:]):
            n = shared(suffixes[a], suffixes[b])
            w = sum(len(texts[b[0]].split("\n")[x].split()) for x in range(b[1], b[1] + n))
            if w >= least:
                want[b] = (a, n, w)
        prefixes = D.common_prefixes(level, placed, least)
        assert {(x["row"], x["line"]): ((x["p_row"], x["p_line"]), x["lcp"], x["lcp_words"]) for x in prefixes.collect()} == want
    longest = {}
    for b, (a, n, _) in want.items():
        for at in (a, b):
            longest[at] = max(n, longest.get(at, 0))
    maximal = {(*at, n) for at, n in longest.items() if longest.get((at[0], at[1] - 1)) != n + 1}
    assert {(x["row"], x["line"], x["length"]) for x in D.maximal_runs(prefixes).collect()} == maximal


def test_toxicity(spark, empty):
    from weftline.llm.toxicity import Lexicon, folded, learn, score_texts

    assert folded("You 1DI0T, ｉdiоt! £5 4 apples") == " you idiot idiot apples "
    assert folded("1d10t $cum tr@sh") == " idiot scum trash " and folded("the 12 trees in 1990") == " the trees in "
    assert folded(None) == folded("") == " "
    clean = [(k, prose(k, 60, ("the", "of", "trash", "can", "tree", "walks"))) for k in range(300)]
    clean = [(i, t.replace("trash", "trash can")) for i, t in clean]
    toxic = [(1000 + k, prose(k, 40, ("the", "of", "tree", "walks", "you")) + " " + ("idiot", "moron", "grumpling", "grumpled")[k % 4] + " " + prose(k + 7, 5, ("tree", "walks"))) for k in range(80)]
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(5, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string").withColumn("tox_score", F.lit("clash"))
    lexicon = learn(docs, labels)
    assert " idiot " in lexicon.weights and any(e.startswith(" grum") for e in lexicon.weights)
    asked = spark.createDataFrame([(1, "what a m0r0n"), (2, "you idiоt you"), (3, "a tree walks"), (4, None), (5, ""), (6, "grumpler")], "doc_id long, text string")
    got = {r["doc_id"]: r["tox_score"] for r in score_texts(asked, lexicon).collect()}
    assert min(got[1], got[2], got[6]) > 0.5, got
    assert got[3] == got[4] == got[5] < 0.3, got
    guarded = Lexicon({" trash ": 3.0}, [" trash can "])
    a = guarded.automaton()
    assert guarded.features(folded("the trash can"), a)[0] == 0 and guarded.features(folded("you trash you"), a)[0] == 3.0
    assert learn(docs, labels.filter("toxic = 0")).weights == {}
    assert score_texts(empty, lexicon).count() == 0


def test_ppm(spark, empty):
    import math
    from collections import Counter

    from weftline.llm import ppm

    rows = [(k, prose(k, 30 + k, ("the", "then", "them", "river", "x", "a\x00b", "Éa", "abcdefghijk", "abcdefghix"))) for k in range(60)] + [(90, None), (91, ""), (92, "neverseen zq " * 3), (None, "the river"), (90, "the the"), (93, "long " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keys string").repartition(3)
    got = sorted(map(tuple, ppm.score_documents(docs, chunk_bytes=2000).collect()), key=repr)
    streams = [(i, brute.ppm_stream(t), [*brute.lower_words(t), b""], i is not None and brute.held(i, 5, 1)) for i, t in rows]
    count = Counter(w for *_, ws, out in streams if not out for w in ws)
    n, v = sum(count.values()), len(count)
    trie = brute.ppm_trie([s for _, s, _, out in streams if not out])
    want = [(i, out, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), brute.ppm_score(s, trie)) for i, s, ws, out in streams]
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5)
    assert ppm.score_documents(empty).count() == 0
    alone = ppm.score_documents(spark.createDataFrame([(1, "no training")], "doc_id long, text string"), held=lambda c, *_: c > 0).first()
    assert alone["score"] == pytest.approx(-len("no training \n") * math.log10(256)) and alone["n_known"] == alone["train_tokens"] == 0


def test_ppm_sums_to_one():
    from weftline.llm.ppm import _MASKS, ORDER, code_lengths, stream_keys

    streams = [b"abab abc ", b"\n", b"cab abab \n", b"a \n"]
    keys = stream_keys(np.frombuffer(b"".join(streams), np.uint8), np.array([len(x) for x in streams]))
    keys, counts = np.unique(keys, return_counts=True)
    low, low_counts = np.unique(np.unique(keys & _MASKS[3]) & _MASKS[2], return_counts=True)
    for context in np.unique(keys >> np.uint64(8)):
        asked = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.exp(code_lengths(asked, keys, counts, low, low_counts)).sum() == pytest.approx(1)
    assert len(keys[0:1]) and int(keys.max()) < 1 << 8 * (ORDER + 1)


def test_ppm_learns_across_words(spark):
    """Another order of the words has another score, and held-out texts score above the base of single words."""
    from weftline.llm.ppm import score_documents

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r for r in score_documents(docs).collect()}
    out = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.1 * sum(r["n_tokens"] for r in out)
    small = spark.createDataFrame([(k, "the old river runs to the cold sea by the stone mill") for k in range(8)] + [(100, "the cold sea by the old mill"), (101, "mill old the by sea cold the")], "doc_id long, text string")
    a, b = (r["score"] for r in score_documents(small, held=lambda c, *_: c >= 100).filter("doc_id >= 100").orderBy("doc_id").collect())
    assert a > b + 1


def test_token_counts(docs, empty, rows, vocabulary, library):
    from weftline.llm.bpe_count import MergeCounter, count_tokens

    got = {r["doc_id"]: r for r in count_tokens(docs, vocabulary).collect()}
    for doc, text, *_ in rows:
        assert got[doc]["n_bytes"] == len((text or "").encode())
        assert got[doc]["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids), doc
    assert count_tokens(empty, vocabulary).count() == 0
    counter, r = MergeCounter(vocabulary), random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "'s", "é", "漢字", "12", "!?", "<|endoftext|>", "<|end", "\U0001f600", "ſ", "-"]) for _ in range(r.randrange(1, 14)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_word_encoder_agrees_with_the_library(vocabulary, library):
    from weftline.llm.wavelet import WordEncoder

    encoder, r = WordEncoder(vocabulary), random.Random(2)
    for _ in range(400):
        text = "".join(r.choice(["a", "the", " ", " of", "  ", "\n", "\x00", "\x1c", "\x85", " ", "'s", "é", "漢字", "12", "!?", "<|endoftext|>", "\U0001f600"]) for _ in range(r.randrange(1, 14)))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_decontamination(spark, docs, rows, empty):
    from weftline.llm.decontaminate import benchmark_hits, is_contaminated, n_hit

    items = [("b", " ".join(prose(2, 80).split()[10:40])), ("a", " ".join(prose(3, 120).split()[:13])), ("short", "One Two"), ("c", None), ("d", "..."), ("e", "spam"), ("a", "ham spam eggs ham")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for block in (1_000_000, 4):
        got = benchmark_hits(docs, benchmark, block_words=block).withColumns({"hit": n_hit(), "bad": is_contaminated()}).collect()
        want = {r[0]: brute.contamination(r[1], items) for r in rows}
        assert {r["doc_id"]: (r["n_words"], r["hit"], r["hit_items"], r["bad"]) for r in got} == want
    assert benchmark_hits(empty, benchmark).count() == 0
    assert {r["hit_items"] == [] for r in benchmark_hits(docs, benchmark.limit(0)).collect()} == {True}


def test_quality_rules(spark, docs, rows, empty):
    from weftline.llm.outliers import judged

    got = {r["doc_id"]: r for r in judged(docs).collect()}
    for doc, text, *_ in rows:
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(text), doc
        assert not (r["kept"] and r["base_failed"])
    assert judged(empty).count() == 0


def test_quality_verdicts(spark):
    """Groups of their own, groups that fall back to their language or to all, and names that clash."""
    from weftline.llm.outliers import judged

    r = random.Random(3)
    size = {("en", "a"): 60, ("en", "b"): 45, ("en", None): 5, ("de", "a"): 20, ("de", "b"): 25, (None, "a"): 3, ("fr", "c"): 1}
    keys = [(lang, source, k) for (lang, source), n in size.items() for k in range(n)]
    rows = [(i, plain(r, 50 + r.randrange(150), k), lang, source) for i, (lang, source, k) in enumerate(keys)]
    rows += [(1000, None, "en", "a"), (1001, "", None, None), rows[3]]
    names = "m_0 double, l_00 double, g_lang string, s_0 int, d2 int, kept int, v_len int, `a.b` int"
    docs = spark.createDataFrame([(*x, 0.5, 1.5, "g", 4, 5, 6, 7, 8) for x in rows], f"doc_id long, text string, lang string, source string, {names}").repartition(3)
    found = judged(docs)
    got = found.collect()
    assert {x["doc_id"] for x in got if x["kept"]} == brute.kept(rows) and len(got) == len(rows)
    assert 0 < sum(not x["kept"] and not x["base_failed"] for x in got) < 40
    assert {(x["m_0"], x["l_00"], x["g_lang"], x["s_0"], x["d2"], x["v_len"], x["a.b"]) for x in got} == {(0.5, 1.5, "g", 4, 5, 7, 8)}
    few = judged(docs.filter("lang = 'fr' OR lang IS NULL"))
    assert {x["kept"] for x in few.filter("NOT base_failed").collect()} == {True}


def plain(r, n, k):
    """Prose in lines; now and then with long words, signs or a repeated passage."""
    words = [r.choice(("stone", "river", "walks", "blue", "hill", "tree")) + (str(r.randrange(900)) if r.random() < 0.8 else "") for _ in range(n)]
    if k % 11 == 3:
        words = [w * 4 for w in words]
    if k % 13 == 5:
        words = [w + "#$%" for w in words]
    if k % 17 == 6:
        words = words[: n // 3] + words[: n // 7]  + words[n // 3 :]
    return "\n".join(" ".join(words[a : a + 12]) for a in range(0, len(words), 12))


def test_outliers_against_numpy(spark):
    """The estimate is a plain one's and no random start finds a much smaller determinant; covariance decides, not a radius."""
    from weftline.llm import outliers

    r = np.random.default_rng(4)
    shape = np.eye(5)
    shape[0, 1] = shape[1, 0] = 0.9
    shape[2, 3] = shape[3, 2] = -0.4
    good = r.multivariate_normal(np.zeros(5), shape, 400)
    bad = r.normal([9, 9, 0, 0, 3], 0.2, (60, 5))
    x = {"one": np.vstack([good, bad]), "two": np.vstack([good[:90] * 3, np.zeros((200, 5))]), "flat": np.c_[good[:50, :1], np.zeros((50, 4))]}
    rows = spark.createDataFrame([(g, *map(float, v)) for g, vs in x.items() for v in vs], "gid string, " + ", ".join(f"{n} double" for n in outliers.VECTOR)).repartition(3)
    found = {e["gid"]: e for e in outliers.estimates(rows).collect()}
    for g, vs in x.items():
        m, c = brute.mcd(vs)
        assert [found[g][f"m_{i}"] for i in range(5)] == pytest.approx(m.tolist(), abs=1e-9), g
        assert [found[g][f"c_{i}{j}"] for i in range(5) for j in range(i + 1)] == pytest.approx([c[i, j] for i in range(5) for j in range(i + 1)], abs=1e-9), g
    m, c = brute.mcd(x["one"])
    mixed = lambda y: np.cov(y.T, bias=True) * outliers.CONSISTENCY * 0.9 + np.eye(5) * 0.1
    best = np.inf
    for _ in range(200):  # concentration from random starts
        core = x["one"][r.choice(460, 6, replace=False)]
        for _ in range(30):
            a, b = core.mean(0), mixed(core)
            d = np.einsum("ij,jk,ik->i", x["one"] - a, np.linalg.inv(b), x["one"] - a)
            core = x["one"][d <= np.sort(d)[344]]
        best = min(best, np.linalg.slogdet(mixed(core))[1])
    estimate = outliers.estimates(rows.filter("gid = 'one'"))
    d2 = np.array([v["d2"] for v in outliers._near(rows.filter("gid = 'one'"), estimate, ["gid"], True).collect()])
    assert (d2 > outliers.FAR).sum() == 60
    inner = x["one"][np.argsort(np.einsum("ij,jk,ik->i", x["one"] - m, np.linalg.inv(c), x["one"] - m))[:345]]
    assert np.linalg.slogdet(mixed(inner))[1] < best + 0.05
    probe = spark.createDataFrame([("one", 5.5, 5.5, 0.0, 0.0, 0.0), ("one", 5.5, -5.5, 0.0, 0.0, 0.0)], rows.schema)
    along, across = (v["d2"] for v in outliers._near(probe, estimate, ["gid"], True).orderBy(F.desc("v_short")).collect())
    assert along < outliers.FAR < across


def test_estimates_of_documents(spark):
    """On the given documents every entry varies in every group, sources have estimates of their own, and two groups judge one vector differently."""
    from weftline.llm import outliers as o

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = o.text_statistics(docs).withColumn("fits", ~o.base_failed()).withColumns(o.statistics()).cache()
    groups = o.groups_of(rows)
    named = rows.filter("fits").join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))).drop("fits")
    scale = o.scales(named)
    fit = named.join(scale, "t_id").withColumns(o.scaled()).select(F.explode(F.array_compact(F.array("t_id", "gid"))).alias("gid"), *o.VECTOR)
    known = o.estimates(fit.cache()).collect()
    assert sum("source" in e["gid"] for e in known) > 10 and sum("language" in e["gid"] for e in known) == 4
    for e in known:
        c = np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                c[i, j] = c[j, i] = e[f"c_{i}{j}"]
        own = (c - o.UNIT * np.eye(5)) / (1 - o.UNIT)
        assert np.diag(own).min() > 0.1 and np.linalg.eigvalsh(own).min() > 0.005, e["gid"]
        assert min(e[f"l_{i}{i}"] for i in range(5)) > o.UNIT**0.5 / 2
    scales = {r["t_id"]: r for r in scale.collect()}
    assert len({round(r["s_0"], 3) for r in scales.values()}) > 1
    judges = o.drawn_estimates(groups, o.estimates(fit)).filter("g_lang = 'en'").select("g_source", *[f"m_{i}" for i in range(5)], *[f"l_{i}{j}" for i in range(5) for j in range(i + 1)])
    probe = judges.withColumns({v: F.lit(x) for v, x in zip(o.VECTOR, (3.0, -2.0, 2.0, 3.0, -2.0), strict=True)}).select(o._squared_distance().alias("d2")).collect()
    assert max(r["d2"] for r in probe) > 1.1 * min(r["d2"] for r in probe)


def test_quality_of_labelled_documents(spark):
    """Of the labelled documents that pass the base rules all bad ones go and all good ones stay."""
    from weftline.llm.outliers import judged

    at = "/root/testdata/sf0.01"
    found = judged(spark.read.parquet(f"{at}/documents.parquet")).filter("NOT base_failed").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    assert {(r["quality"], r["kept"]) for r in found.select("quality", "kept").distinct().collect()} == {(0, False), (1, True)}


def test_components(spark):
    from weftline.llm.graph import connected_components

    r = random.Random(6)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_parts(spark, monkeypatch):
    """A small table is joined in one pass over it, parts of a larger one give the same."""
    from weftline.llm import graph

    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 500)]
    want = {}
    for e in edges:
        own = set().union(*(want.get(n, {n}) for n in e))
        want |= dict.fromkeys(own, own)
    want = {n: min(c) for n, c in want.items() if len(c) > 1}
    frame, staged = spark.createDataFrame(edges, "a long, b long"), []
    monkeypatch.setattr(graph, "stage", lambda df, name, f=graph.stage: staged.append(name) or f(df, name))
    for part, least in ((250_000, 0), (40, 3)):
        staged.clear()
        monkeypatch.setattr(graph, "PART_EDGES", part, raising=False)
        assert {x["node"]: x["root"] for x in graph.connected_components(frame).collect()} == want
        assert (len(staged) == 2) if part > 300 else (len(staged) > least)


def test_join_of_a_chain_of_pairs(spark, monkeypatch):
    """Candidate pairs in a long chain, few of them links, are compared pair by pair and not block by block."""
    from weftline.llm import common, ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 10)
    r = random.Random(6)
    rows, w = [], prose(21, 100).split()
    for k in range(160):
        rows.append((k, " ".join(w)))
        w = list(w)
        for i in r.sample(range(100), 1 if k % 4 == 0 else 6):
            w[i] = f"new{k}x{i}"
    sent = []
    monkeypatch.setattr(ngram_join, "_links", lambda tasks, percent, f=ngram_join._links: sent.append(tasks.count()) or f(tasks, percent))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for sieved in (False, True):
        if sieved:
            monkeypatch.setattr(ngram_join, "NARROW_ROWS", 5)
            monkeypatch.setattr(ngram_join, "join_sieved", lambda *a, f=common.join_sieved, **b: f(*a, **b | {"rows": 3}), raising=False)
        sent.clear()
        check_join(spark, docs, rows)
        assert sum(sent) < 5 * len(rows)
