"""Operators that map rows: odd rows, clashing columns, and results against plain versions."""

import base64
import collections
import hashlib
import html as html_lib
import json
import math
import random
import re
import wave
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import ctw, decontam, html_main, langid, media, spm, tokens, toxic, warc
from plumbline.llm.textops import ALNUM, NONSPACE, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, "One two three four five six seven eight nine ten eleven."), (1, "One two three four five six seven eight nine ten eleven."), (2, None), (3, ""), (4, " \n\t "), (None, "alone"), (5, "É ü 梦 \U0001f600 x" * 40), (6, "word " * 30000)]


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 AS n_words", "2 AS n_tokens", "3 AS score", "'x' AS lang_pred", "4 AS k", "5 AS t", "6 AS media") if extra else df


# words -------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZé9 \n\t\x0b\x1f\x85,梦", max_size=12), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for chars, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NONSPACE, r"[^\x20\x09-\x0D]+")):
        h, first = words(pa.array(texts, pa.string()), chars)
        plain = [re.findall(pattern, t.translate(LOW)) for t in texts]
        assert np.diff(first).tolist() == [len(x) for x in plain]
        flat = [w for x in plain for w in x]
        assert len(set(h.tolist())) == len(set(flat))
        assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


# 1 -----------------------------------------------------------------------------------------------------------------


def plain_hits(text, items, size=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit, ids = set(), set()
    for key, item in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(LOW))
        for i in range(max(1, len(v) - size + 1) if v else 0):
            part = v[i : i + size]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    ids |= {str(key)} if key is not None else set()
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


ITEMS = [(7, "a b c d e f g h i j k l"), (70, "Short one"), (8, None), (9, "..."), (None, "q r s"), (70, "Short one"), (10, "a b c d e f g h i j")]


@pytest.mark.parametrize("limit", [1 << 20, 20])
def test_contamination_is_the_plain_one(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BLOCK", limit)
    monkeypatch.setattr(decontam.windows, "__defaults__", (10, limit))
    rng = random.Random(5)
    rows = [*ODD, *((100 + i, " ".join(rng.choice(["a b c d e f g h i j k l", "B c D-e f g", "short ONE", "q r s", "x", "é"]) for _ in range(rng.randint(0, 5)))) for i in range(40))]
    got = decontam.contamination(docs_of(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(map(str, (tuple(r)[:6] for r in got.collect()))) == sorted(map(str, ((k, *plain_hits(t, ITEMS)) for k, t in rows)))
    kept = decontam.clean(docs_of(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.count() == sum(not plain_hits(t, ITEMS)[4] for _, t in rows) and "media" in kept.columns


def test_spans_point_into_the_original(spark):
    row = decontam.contamination(docs_of(spark, [(1, "É, SHORT; one! x")], False), spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    assert "É, SHORT; one! x"[row.spans[0] : row.spans[1]] == "SHORT; one"


def test_nothing_to_decontaminate(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.contamination(docs_of(spark, ODD), none).collect()] == [0] * len(ODD)
    assert decontam.contamination(docs_of(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# 3 -----------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    got = media.analyse(media.encode(docs_of(spark, ODD)), ["doc_id", "n_bytes"]).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for k, t in ODD:
        p = (t or "").encode()
        p += bytes(-len(p) % 64 if p else 64)
        for r in by[k]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert by[1][0][1:] == by[1][1][1:] and by[2][0].feature == by[3][0].feature


def test_wav_is_read_by_the_wave_module():
    with wave.open(io.BytesIO(media.to_wav(b"abc" * 64))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(999)) == (1, 1, b"abc" * 64)


def test_blocks_of_frames_make_no_difference(monkeypatch):
    payload = np.random.default_rng(3).integers(0, 256, 64 * 400, dtype=np.uint8).tobytes()
    whole = media.peaks(payload)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    parts = media.peaks(payload)
    assert whole[0] == parts[0] and (whole[1] == parts[1]).all() and (whole[2] == parts[2]).all()


def test_peaks_are_the_largest_of_their_neighbourhood():
    payload = np.random.default_rng(4).integers(0, 256, 64 * 60, dtype=np.uint8).tobytes()
    n, t, f = media.peaks(payload)
    x = np.zeros((n - 1) * media.HOP + media.FRAME, np.float32)
    x[: len(payload)] = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    p = media.power(x)
    want = [(i, j) for i in range(n) for j in range(1, p.shape[1]) if p[i, j] > 1e-3 and p[i, j] == p[max(0, i - 3) : i + 4, max(0, j - 4) : j + 5].max()]
    assert list(zip(t.tolist(), f.tolist(), strict=True)) == want


# 4 -----------------------------------------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(["a", "b", " ", "\n", "é", "梦", "\U0001f600", "t", "h", "e", "i", "n", "g", "1", ".", "#", "\t", "Z", ","]), max_size=40))
def test_pieces_are_the_librarys(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = spm.loaded(MODEL).encode(text)
    assert ids == library.encode(text) and spm.loaded(MODEL).decode(ids) == text
    assert b"".join(spm.loaded(MODEL).packed_all(pa.array([text, None, text]))) == np.array(ids * 2, np.int32).tobytes()


def test_unigram_way_has_the_best_score():
    pieces = spm.loaded(MODEL)
    own = object.__new__(spm.Pieces)
    own.__dict__ |= pieces.__dict__
    rng = random.Random(2)
    own.scores = [-5 - rng.random() * 5 for _ in pieces.scores]
    own.automaton = spm.ahocorasick.Automaton()
    for x, i in own.ids.items():
        own.automaton.add_word(x, (i, len(x), own.scores[i]))
    own.automaton.make_automaton()
    own.worst = min(own.scores) - spm.UNKNOWN_COST

    def best(t):
        if not t:
            return 0.0
        ways = [own.scores[own.ids[t[:n]]] + best(t[n:]) for n in range(1, len(t) + 1) if t[:n] in own.ids]
        return max(ways + ([own.worst + best(t[1:])] if t[0] not in own.chars else []))

    for t in ("▁thing", "▁the梦x", "\U000e0001ab", "▁ininin"):
        ids = own._unigram(t)
        assert own.decode(ids).lstrip(" ") == t.replace("▁", "")
        n_unknown = sum(c not in own.chars for c in t)
        score = sum(own.scores[i] for i in ids if own.kinds[i] == 1) + n_unknown * own.worst
        assert math.isclose(score, best(t))


def test_odd_texts_come_back(spark):
    got = spm.round_trip(docs_of(spark, ODD), MODEL).collect()
    assert len(got) == len(ODD) and all(r.intact for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[2] == 0
    with pytest.raises(ValueError):
        spm.encode(docs_of(spark, ODD).withColumnRenamed("k", "ids"), MODEL, ["doc_id", "ids"])


# 5 -----------------------------------------------------------------------------------------------------------------


def page(i, body="", host="h.example"):
    nav = "<nav><a href=/a>Home</a></nav><div class=top><p>Same line on all pages.</p></div>"
    return (i, f"https://{host}/{i}", f"<html><head><title>T</title><script>var t='</p>';</script></head><body>{nav}<div id=x><h2>Title {i}</h2>{body}</div><footer>&copy; x</footer></body></html>")


def test_templates_go_and_the_rest_stays(spark):
    rows = [page(i, f"<p>Own &amp; text {i}<br>of  it <i>all</i>.<ul><li>One {i}<li>Two {i}</ul>") for i in range(8)]
    rows += [(90, "https://other.example/", rows[0][2]), (91, None, "<p>no host"), (92, "x", None), (93, "x", ""), (93, "x", ""), (None, "x", "a < b &lt; c <b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS k", "3 AS host")
    for most in (10, 0):
        got = {(r.page_id, r.url): r.text for r in html_main.extract(df, broadcast_most=most).collect()}
        assert got[3, "https://h.example/3"] == "Title 3\n\nOwn & text 3 of it all.\n\nOne 3\n\nTwo 3"
        assert got[90, "https://other.example/"].startswith("Same line on all pages.\n\nTitle 0")
        assert got[91, None] == "no host" and got[92, "x"] == got[93, "x"] == ""
        assert got[None, "x"].startswith("a < b < c")


def test_articles_are_no_templates_and_named_parts_go(spark):
    article = "<main><article><h1>T</h1><p>All pages have this article.</p><aside>no</aside><div class='reader-comments'>no</div><form>no</form></article></main><div class='cookie notice'>no</div><section id=sidebar>no</section>"
    df = spark.createDataFrame([(i, f"http://a.b/{i}", article) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_main.extract(df).collect()} == {"T\n\nAll pages have this article."}
    assert html_main.extract(df.limit(0)).count() == 0


def test_wrapped_articles_stay(spark):
    rows = [(i, f"http://a.b/{i}", f"<body><div id=page><div><p>Same on all.</p></div><section><article><p>Own {i}.</article></section></div></body>") for i in range(40)]
    rows += [(100 + i, f"http://c.d/{i}", f"<div><main>Own {i}.</main></div>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (10, 0):
        got = {r.page_id: r.text for r in html_main.extract(df, broadcast_most=most).collect()}
        assert got == {i: f"Own {i % 100}." for i, *_ in rows}


def test_templates_inside_articles_go(spark):
    box = "<div class=x1><p>Get our app.</p></div>"
    rows = [(i, f"http://a.b/{i}", f"<main><article><p>Own {i}.</p>{box}<p>End {i}.</p></article>{box}</main>") for i in range(20)]
    rows += [(100 + i, f"http://a.b/c{i}", f"<article><p>A copied article.</p></article><p>{i}</p>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (10, 0):
        got = {r.page_id: r.text for r in html_main.extract(df, broadcast_most=most).collect()}
        assert got == {i: f"Own {i}.\n\nEnd {i}." if i < 100 else f"A copied article.\n\n{i - 100}" for i, *_ in rows}


def test_templates_go_on_large_hosts(spark):
    df = spark.range(12_000).selectExpr("id AS page_id", "'http://a.b/' AS url", "concat('<p>Own text ', id, '.</p>', if(id < 110, '<div>A box here.</div>', '')) AS html")
    got = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert got == {i: f"Own text {i}." for i in range(12_000)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>/!-pbdiv=\"' &;a")), max_size=60))
def test_any_markup_is_read(text):
    root = html_main.parse(text)
    html_main.tree_hash(root, "h")
    html_main.main_text(root, set())


def test_depth_has_no_limit():
    assert html_main.main_text(html_main.parse("<div>" * 30000 + "x"), set()) == "x"


# 7 -----------------------------------------------------------------------------------------------------------------


def test_ngrams_are_the_plain_ones():
    texts = ["Ab cd!!ef", None, "", "x", "é", "123", "abc", " a  b ", "ÀÉ"]
    g, first = langid.ngrams(pa.array(texts))
    for i, t in enumerate(texts):
        b = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + (t or "").lower().encode() + b" ")
        assert [x.to_bytes(4, "big") for x in g[first[i] : first[i + 1]].tolist()] == [b[j : j + 4] for j in range(len(b) - 3)]


def test_languages_are_told_apart(spark):
    rows = [(i, t, l) for i in range(40) for l, t in (("en", "the thing that was with them " * 3), ("de", "und der die das nicht ist " * 3))]
    rows += [(100, None, "en"), (101, "123 !!", None), (102, "the thing", None), (103, "", "xx"), (None, "nicht der", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS gram", "2 AS n", "3 AS score")
    got = langid.learn_and_identify(df, df["doc_id"] > 99).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "en", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got) and by[102].held_out and not by[None].held_out
    none = langid.learn_and_identify(df, df["doc_id"].isNull() | (df["doc_id"] > -1)).filter("doc_id = 102").first()
    assert none.lang_pred == "und"
    assert langid.in_language(df, langid.train(df), 0.2).filter("doc_id >= 100").count() == 1


def test_false_positives_are_corrected():
    rng = np.random.default_rng(1)
    f = langid.build(["a", "b"], rng.integers(0, 1 << 31, 300_000).astype(np.uint32), np.zeros(300_000, int))
    found = f.hits(rng.integers(1 << 31, 1 << 32, 200_000).astype(np.uint32))[:, 0]
    assert abs((found & 1).mean() - f.wrong[0]) < 0.01 and f.wrong[1] == 0


# 8 -----------------------------------------------------------------------------------------------------------------

BPE = public_tokenizers.path("byte_bpe_50k.json")


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_are_the_librarys(spark):
    rows = [*ODD, (20, "<|endoftext|> a<|endoftext|><|endoftext|>"), (21, "a" * 5000 + " " * 3000 + "b"), (22, "ǅ ɐ ⁇ 1２ ١"), (23, "don't I'll   x\n\n y")]
    got = tokens.count_tokens(docs_of(spark, rows), BPE).collect()
    want = [(k, len((t or "").encode()), n, n > 512) for (k, t), n in zip(rows, library_counts([t for _, t in rows]), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_merges_out_of_order_have_no_ranks():
    with open(BPE, encoding="utf-8") as f:
        spec = json.load(f)
    assert len(tokens.byte_ranks(spec)) == 50256
    spec["model"]["merges"][3:5] = spec["model"]["merges"][3:5][::-1]
    assert tokens.byte_ranks(spec) is None


# 9 -----------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 10, 25, 3]), max_size=25))
def test_segments_are_all_maximal_ones(values):
    other = -7
    x = [v or other for v in values]

    def maximal(a, b):  # by their definition: the best of a range, then those left and right of it
        if a >= b:
            return []
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best[0] <= 1e-9:
            return []
        return maximal(a, best[3]) + [(best[3], best[4] - 1)] + maximal(best[4], b)

    at = [i for i, v in enumerate(values) if v]
    got = toxic.segments(at, [values[i] for i in at], other)
    want = maximal(0, len(x))
    assert math.isclose(sum(s for s, _, _ in got), sum(sum(x[a : b + 1]) for a, b in want), abs_tol=1e-9)
    assert all(math.isclose(s, sum(x[a : b + 1]), abs_tol=1e-9) for s, a, b in got)


def test_a_passage_counts_wherever_it_stands():
    model = toxic.Model(words={b"vile": 5.0, b"nasty": 5.0}, other=-0.5)
    passage, rest = [b"vile", b"nasty"], [b"on"] * 400
    words = [*passage, *rest, b"vile", *rest, *passage]
    found = toxic.passages(words, model)
    assert [x[1:] for x in found] == [(0, 1), (803, 804)] and found[0][0] == found[1][0]


def test_toxic_texts_are_found(spark):
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice(["on", "the", "of", "ring", "stand", "over"]) for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, plain() + (" vile foulness, nasty" if bad else "") + " " + plain()))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, plain() + " Vile nasty foulness"), (1003, plain()), (1004, "x vile foulnesses nasty")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS y", "3 AS toxic")
    lab = spark.createDataFrame([*labels, (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxic.train(df, lab, lab["doc_id"] % 4 != 2)
    got = {r.doc_id: r for r in toxic.toxicity(df, model, ["doc_id"]).collect()}
    assert len(got) == len(rows) and [got[k].predicted for k in range(1000, 1005)] == [0, 0, 1, 0, 1]
    assert sum(got[k].predicted == y for k, y in labels) == 300
    assert got[1002].passages == [60, 62]
    assert toxic.without_toxic(df, model).count() == sum(not r.predicted for r in got.values())
    assert toxic.train(df, lab.limit(0), lab["doc_id"] > 0).base == -20 and toxic.train(df.limit(0), lab, lab["doc_id"] > 0).slope == 0


# 10 ----------------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (3, None, None), (4, " ", ""), (5, "x\ny", "é梦" * 50), (5, "again", "other"), (9, "http://a/9", "same"), (None, "n", "same"), (None, "n", "lone")]


def plain_records(rows):
    top = {}
    for k, _, h in rows:
        if k is not None:
            top[h or ""] = max(k, top.get(h or "", k))
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        to = top.get(h or "")
        to = None if to is None or to == k else to
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(map(str, out))


def test_archives_read_back(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS d", "2 AS shard")
    got = warc.archived(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == plain_records(PAGES)
    assert warc.archived(df.limit(0)).count() == 0


def test_files_depend_on_rows_alone(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdef <>\n") for _ in range(rng.randint(0, 900))) if i % 7 else "copy") for i in range(400)]
    sums = []
    for n, order in ((1, rows), (5, rows[::-1])):
        df = spark.createDataFrame(order, "page_id long, url string, html string").repartition(n)
        out = f"file://{tmp_path}/{n}"
        manifest = warc.write(df, out, shard_bytes=40_000, roll_bytes=6_000)
        sums.append(sorted(map(tuple, manifest.collect())))
        assert not (tmp_path / str(n) / "tmp").exists()
        got = warc.read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(str(tuple(r)) for r in got) == plain_records(rows)
    assert sums[0] == sums[1] and len({f.split("-")[1] for f, *_ in sums[0]}) > 3 and len(sums[0]) > len({f.split("-")[1] for f, *_ in sums[0]})


def test_small_payloads_may_all_be_responses(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/o", least=5)
    assert warc.read(spark, f"file://{tmp_path}/o").filter("record_type = 'revisit'").count() == 0


def test_a_changed_payload_is_noticed(spark, tmp_path):
    import gzip

    warc.write(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), f"file://{tmp_path}/o")
    file = next((tmp_path / "o").glob("*.warc.gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"payload\r\n", b"PAYLOAD\r\n")))
    with pytest.raises(Exception, match="has changed"):
        warc.read(spark, f"file://{tmp_path}/o").collect()


# 6 -----------------------------------------------------------------------------------------------------------------


def test_kt_is_sequential():
    p = 0.0
    z = o = 0
    for bit in [0, 1, 1, 0, 1, 1, 1, 0]:
        p += math.log(((o if bit else z) + 0.5) / (z + o + 1))
        z, o = z + (not bit), o + bit
    assert math.isclose(p, float(ctw.log_kt(np.array([float(z)]), np.array([float(o)]))[0]), rel_tol=1e-9)


def tree_of(texts, least=1):
    g, _ = ctw.grams(*ctw.raw(pa.array(texts)))
    levels = []
    for d in range(ctw.DEPTH + 1):
        level = {}
        for x in g.tolist():
            level.setdefault(x >> 8 & (1 << 8 * d) - 1, np.zeros(256, np.int64))[x & 255] += 1
        level = {c: n for c, n in level.items() if not d or n.sum() >= least and c & (1 << 8 * (d - 1)) - 1 in levels[-1]}
        levels.append(level)
    rows = [[(c, x, int(n)) for c, own in level.items() for x, n in enumerate(own) if n] for level in levels]
    return ctw.build([tuple(np.array([r[i] for r in own], np.int64) for i in range(3)) for own in rows]), levels


@pytest.mark.parametrize("least", [1, 3])
def test_tree_is_the_weighted_one(least):
    texts = ["abracadabra", "abrakadabra, abra", "", "é"]
    tree, levels = tree_of(texts, least)

    def weighted(d, c, bit_path):  # log probability of one decision's sequence at a context, by the definition
        def counts(n):
            low, high = 0, 256
            for b in bit_path:
                mid = (low + high) // 2
                low, high = (mid, high) if b else (low, mid)
            mid = (low + high) // 2
            return float(n[low:mid].sum()), float(n[mid:high].sum())

        own = levels[d][c]
        kids = [k for k in levels[d + 1] if k & (1 << 8 * d) - 1 == c] if d < ctw.DEPTH else []
        kt = lambda n: float(ctw.log_kt(*[np.array([x]) for x in counts(n)])[0])
        if not kids:
            return kt(own)
        rest = own - sum(levels[d + 1][k] for k in kids)
        return float(np.logaddexp(kt(own), kt(rest) + sum(weighted(d + 1, k, bit_path) for k in kids)) - math.log(2))

    total = tree.logp.astype(float)[:, tree.column]
    assert np.allclose((10**total).sum(1), 1, atol=1e-4)
    # A byte's chance is the ratio of the weighted probabilities with and without it, decision by decision.
    data = "dabr".encode()
    g, _ = ctw.grams(*ctw.raw(pa.array(["dabr"])))
    for x in g.tolist():
        byte, want = x & 255, 0.0
        for bit in range(8):
            path = [byte >> (7 - i) & 1 for i in range(bit)]
            before = weighted(0, 0, path)
            changed = []
            for d in range(ctw.DEPTH + 1):
                c = x >> 8 & (1 << 8 * d) - 1
                if c in levels[d]:
                    levels[d][c][byte] += 1
                    changed.append((d, c))
                else:
                    break
            want += weighted(0, 0, path) - before
            for d, c in changed:
                levels[d][c][byte] -= 1
        p = tree.logp[tree.places(np.array([x], np.uint64))[0], tree.column[byte]]
        assert math.isclose(p, want / math.log(10), abs_tol=1e-4)


@pytest.mark.parametrize(("least", "places"), [(1, 10**6), (3, 10**6), (2, 60)])
def test_the_learned_tree_is_the_plain_one(spark, monkeypatch, least, places):
    """Counts gathered in parts give the scores of a tree that plain counts give, and PLACES bounds it."""
    texts = ["abracadabra " * 3, "abrakadabra, abra", "", "é été", None, "the cat, the hat " * 5]
    monkeypatch.setattr(ctw, "LEAST", least)
    monkeypatch.setattr(ctw, "NODES", 0)
    monkeypatch.setattr(ctw, "PLACES", places)
    built = []
    monkeypatch.setattr(ctw, "build", lambda rows, whole=ctw.build: built.append(whole(rows)) or built[-1])
    df = docs_of(spark, list(enumerate(texts)))
    got = {r.doc_id: r.score for r in ctw.score(df, df["doc_id"] < 0).collect()}
    assert len(built[0].logp) <= places
    if places > 100:
        want = tree_of([t or "" for t in texts], least)[0]
        assert len(want.logp) == len(built[0].logp)
        assert np.allclose([got[i] for i in range(len(texts))], want.score(pa.array([t or "" for t in texts])), atol=1e-3)


def test_grams_are_the_plain_ones():
    texts = ["abc", "", None, "é" * 9]
    g, first = ctw.grams(*ctw.raw(pa.array(texts)))
    for i, t in enumerate(texts):
        b = b"\xff" * ctw.DEPTH + (t or "").encode() + b"\xff"
        assert g[first[i] : first[i + 1]].tolist() == [int.from_bytes(b[j : j + ctw.DEPTH + 1], "big") for j in range(len(b) - ctw.DEPTH)]


def test_base_scores_are_the_plain_ones(spark, monkeypatch):
    rows = [*ODD, *((50 + i, f"the Word{i % 9} of the {i}") for i in range(60))]
    df = docs_of(spark, rows).selectExpr("*", "1 AS part", "2 AS kind", "3 AS id")
    for heads in (1 / (1 << 20), 0.05, 1.0):
        monkeypatch.setattr(ctw, "HEADS", heads)
        got = ctw.score(df, df["doc_id"] % 3 == 0).collect()
        tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None]
        c = collections.Counter(w for k, t in rows if k is None or k % 3 for w in tok(t))
        n, v = sum(c.values()), len(c)
        want = {k: (len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t))) for k, t in rows}
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)
    untrained = ctw.score(df, df["doc_id"].isNull() | (df["doc_id"] > -1)).filter("doc_id = 3").first()
    assert untrained.train_tokens == 0 and math.isclose(untrained.bits_per_byte, 8, rel_tol=1e-6)
    assert ctw.score(df.limit(0), df["doc_id"] > 5).count() == 0
