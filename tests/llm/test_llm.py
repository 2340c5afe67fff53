import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlink.llm import decontaminate, html_text, language_id, license_scan, mixing, near_dup, quality_net, quality_rules, token_files, warc
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("word_bpe_49k.json")


def odd_docs(spark):
    """Nulls, blanks, a long text, ties, repeated rows, a null id and clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "a", None), (4, long, "en", "b", 1), (5, "one two", "fr", "b", 7), (6, "one two", "fr", "c", 7), (6, "one two", "fr", "c", 7), (None, "some words stand here in a row", None, "c", 3)]
    return spark.createDataFrame(rows, DOCS).withColumns({"rep": F.lit(1), "row": F.lit("x"), "score": F.lit(0), "words": F.lit(2)})


def empty(spark):
    return odd_docs(spark).limit(0)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 40, 120)))] for _ in range(30)]
    rows = []
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, f"{passage} " + " ".join(f"u{i}_{j}" for j in range(30))) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_components(rows)


def test_near_duplicates_odd_input(spark):
    got = near_dup.near_duplicates(odd_docs(spark)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[1]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["component_id"] is None and by[None]["kept"]
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_decontamination_against_brute_force(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog today"), (2, "two words"), (3, None), (4, " "), (5, "a b c d e")]
    texts = [(1, "say THE quick brown fox jumps over the lazy dog today ok"), (2, "the quick brown fox jumps over the lazy cat"), (3, "x two words y"), (4, "two\twords"), (5, None), (None, "a b c d e"), (6, "a b c d e f"), (6, "a b c d e f")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 2), (6, 5)}
    kept = decontaminate.clean(spark.createDataFrame(texts, "doc_id long, text string"), bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "5"]
    assert decontaminate.contaminated(odd_docs(spark), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(empty(spark), bench).count() == 0 and decontaminate.contaminated(odd_docs(spark), bench).count() == 0


def test_license_scan(spark):
    text = "Intro.\nReleased under the MIT License.\nThen: licensed under CC BY-NC 4.0, mit license again"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    at = [i for i in range(len(words)) if words[i : i + 2] == ["mit", "license"]]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), 2, at[0], at[-1])
    assert r["base_labels"] == "mit" and r["labels"] == "cc-by-nc,mit" and r["score"] == 1.0
    out = license_scan.scan(odd_docs(spark)).collect()
    assert len(out) == 8 and all(x["labels"] == "" and x["score"] == 0 for x in out)
    assert license_scan.scan(empty(spark)).count() == 0


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(spark):
    d = docs(spark)
    rules = quality_rules.learn(d, spark.read.parquet(f"{SF}/labels.parquet"))
    out = {r["doc_id"]: r for r in quality_rules.judged(d, rules).collect()}
    for r in d.collect():
        s = plain_statistics(r["text"])
        got = out[r["doc_id"]]
        assert s == (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"])
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        values = {"words": s[0], "word_length": s[1] / max(1, s[0]), "symbol_rate": s[2] / max(1, s[1]), "dup_line_rate": s[3] / max(1, got["n_lines"]), "repeat_rate": s[4] / max(1, s[0]), "upper_rate": got["n_upper"] / max(1, s[1]), "distinct_rate": got["n_distinct"] / max(1, s[0])}
        assert got["base_failed"] == failed and got["kept"] == (not failed and not any(all(c.holds(values) for c in rule) for rule in rules))
    assert rules and all(r["base_failed"] for r in quality_rules.judged(odd_docs(spark), []).where("doc_id in (1, 2, 3)").collect())
    assert quality_rules.judged(empty(spark), rules).count() == 0 and quality_rules.learn(d, spark.createDataFrame([(1, None)], "doc_id long, quality int")) == []


def test_apportionment_against_highest_quotients():
    rng = np.random.default_rng(3)
    for _ in range(30):
        votes, seats = rng.integers(0, 50, 6).astype(float), int(rng.integers(0, 40))
        want = np.zeros(6, int)
        for _ in range(seats if votes.any() else 0):
            want[int(np.argmax(np.where(votes > 0, votes / (2 * want + 1), -1)))] += 1
        got = mixing.apportion(votes, seats)
        assert got.sum() == want.sum() and np.allclose(sorted(votes[votes > 0] / (2 * got[votes > 0] + 1)), sorted(votes[votes > 0] / (2 * want[votes > 0] + 1)))


def test_mixing(spark):
    d = docs(spark).where("source in ('src0', 'src1', 'src2')").withColumn("source", F.when(F.col("source") != "src2", F.col("source")))
    a, b = (sorted(mixing.mix(d).collect()) for _ in range(2))
    assert a == b and all(r["taken"] <= 3 * r["size"] for r in a)
    by = {}
    for r in a:
        by.setdefault(r["source"], []).append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in ("src0", "src1", None)]
    for s, t in zip(("src0", "src1", None), mixing.targets(sizes), strict=True):
        assert by[s][0]["target"] == t and abs(sum(r["taken"] for r in by[s]) - t) <= 0.01 * t + 5
    assert mixing.targets([10, 1000, 1000]) == [30.0, *[1980 * w / 3 for w in (2, 1)]]
    odd = mixing.mix(odd_docs(spark)).collect()
    assert len(odd) == 8 and all(r["taken"] == 0 for r in odd if r["size"] == 0)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(odd_docs(spark)).columns == odd_docs(spark).columns


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 3000):
        for most in (1, 2, 16, 50_000, 2**60, 2**64 - 1):
            ids = rng.integers(0, most, n, dtype=np.uint64)
            assert (token_files.unpack(*token_files.pack(ids), n) == ids).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    tok, at, want = Tokenizer.from_file(BPE), 0, []
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()] + [(9001, "\x1c a\x85b ²  <|endoftext|>'s"), (9002, None), (9003, "İΣ")]
    for i, t in sorted(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.token_table(spark.createDataFrame(rows, "doc_id long, text string"), BPE)
    assert sorted(tuple(r)[:4] for r in got.collect()) == want
    assert token_files.token_table(odd_docs(spark), BPE).count() == 8 and token_files.token_table(empty(spark), BPE).count() == 0


def test_encoder_is_the_tokenizer_on_random_texts(monkeypatch):
    monkeypatch.setattr(token_files, "CUT_BYTES", 64)
    monkeypatch.setattr(token_files, "CACHE_PIECES", 1 << 8)
    monkeypatch.setattr(token_files, "CACHE_IDS", 1 << 10)
    rng, coder = random.Random(5), token_files.Encoder(BPE, 2)
    plain = [*"abcXYZ'''sStTrReEvVlLmMdD  \t\n\r\x0b\x0c\x00\x01\x1b0123456789!?-.,<>_éÀÿßÞøñ", "'s", "'re", "'LL", "'ve", "!'s", "''s"]
    odd = [*plain, *"\x1c|²×÷中е́\x85\xa0İΣ\x7f😀", "<|endoftext|>", "<|"]
    runs = [c * n for c in "a\x00é='" for n in (7, 8, 9, 14, 15, 16, 17, 99, 100, 300)]
    for _ in range(100):
        some = [rng.choice([None, "", "".join(rng.choices(rng.choice([plain, plain, odd]), k=rng.choice([1, 2, 5, 30, 200]))), rng.choice(runs)]) for _ in range(rng.randrange(1, 30))]
        array = pa.array(some, pa.string()).slice(rng.randrange(2))
        lengths, ids = coder.all(array)
        want = [[*coder.tok.encode(t or "", add_special_tokens=False).ids, 2] for t in array.to_pylist()]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_asks_the_model_once_for_a_piece():
    class Counted:
        def __init__(self, model):
            self.model, self.asked = model, 0

        def tokenize(self, piece):
            self.asked += 1
            return self.model.tokenize(piece)

    coder = token_files.Encoder(BPE, 2)
    coder.model = Counted(coder.model)
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(420_000)]
    some = pa.array([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
    coder.all(some)
    coder.all(some)
    assert coder.model.asked < 1.2 * len(words)  # it was twice as many


def test_warc(spark):
    rows = [(3, "http://www.b.com/x#f", "same"), (1, "https://a.b.com/?q=1", "same"), (2, None, None), (4, "http://a.com/", "WARC/1.1\r\n\r\nContent-Length: 3"), (4, "http://a.com/", "é"), (None, "u", "same")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))).collect()
    assert len(got) == 6
    for r in got:
        if r["page_id"] in (1, 2, 3):
            body = {1: b"same", 3: b"same", 2: b""}[r["page_id"]]
            assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "response", None)} == kinds
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_near_dedup_recall(spark, monkeypatch):
    import corpus_pipeline

    seen, real = {}, near_dup.near_duplicates
    monkeypatch.setattr(near_dup, "near_duplicates", lambda docs, **options: seen.update(options) or real(docs, **options))
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(words), "en", "a", 0), (2, " ".join(words[:40] + ["x"] + words[40:]), "en", "a", 0), (3, "an other text of seven words here", "en", "a", 0)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), SF)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3]
    s, halves, per = seen["percent"] / 100, seen.get("halves", near_dup.HALVES), seen.get("rows", near_dup.ROWS)
    assert (1 - (1 - s**per) ** halves) ** 2 > 0.9999


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(6))) for _ in range(k)]
        assert [x[0] for x in warc.LoserTree(runs)] == sorted(x[0] for r in runs for x in r)


def test_language_id(spark):
    d = docs(spark).withColumn("held", F.pmod("doc_id", F.lit(3)) == 1)
    model = language_id.train(d.where("not held"))
    out = language_id.identify(d.where("held"), model, keep=("doc_id", "lang"))
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    odd = {r["doc_id"]: r for r in language_id.identify(odd_docs(spark), model).collect()}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[3]["lang_pred"] == "und" and odd[1]["score"] == 0
    none = language_id.train(odd_docs(spark).where("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(odd_docs(spark), none).collect()} == {"und"}
    rows = d.where("not held and text is not null").collect()
    alphabet = sorted({c for r in rows for w in language_id.tokens(r["text"]) for c in w})
    for context in ("", "t", "th", "zzq"):  # what follows a context: a known character, the end mark or an unknown character
        codes, starts = language_id._codes([context + c for c in alphabet])
        known = model.probabilities(codes, starts)[starts[:-1] + len(context) + 1].sum(axis=0)
        end, unknown = (model.probabilities(*language_id._codes([context + c]))[len(context) + 1] for c in ("", "\uffff"))
        assert (abs(known + end + unknown - 1) < 0.01).all()  # the alphabet has characters of the calibration texts besides


def test_language_id_keeps_rare_languages(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26)} words", f"l{i:02}") for i in range(40)] + [(100 + i, " ", "l00") for i in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{i:02}" for i in range(40)]
    assert language_id.SAMPLE_DOCS == 400


def test_quality_net(spark):
    d, labels = docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    net = quality_net.train(d, labels)
    out = quality_net.score(d, net).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.9 * len(out)
    odd = quality_net.score(odd_docs(spark), net).collect()
    assert len(odd) == 8 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_net.score(empty(spark), net).count() == 0
    assert quality_net.fit([], []).constant == 0.5


def test_quality_net_sees_every_window():
    rng = np.random.default_rng(8)
    n_filters = quality_net.FILTERS
    net = quality_net.Net(np.eye(256, 4, dtype=np.float32), rng.normal(size=(32, n_filters)).astype(np.float32), np.zeros(n_filters, np.float32), np.zeros(2 * n_filters, np.float32))
    net.embed[ord("!")] = 9
    for n in (40, 20_000):  # a pattern gives the same largest activations at any offset
        body = lambda at: np.frombuffer(b" " * at + b"!" + b" " * (n - at - 1), np.uint8)  # noqa: E731, B023
        tops = [quality_net.row_of(net, body(at))[n_filters:] for at in range(10, 18)]
        assert np.allclose(tops, tops[0])
    body = rng.integers(0, 256, 3000).astype(np.uint8)
    act = np.stack([net.embed[body[i : i + 8]].reshape(32) @ net.conv for i in range(3000 - 7)])  # window by window
    chunks = [body_act.max(axis=0) for body_act in (act[at : at + quality_net.STEP] for at in range(0, len(act), quality_net.STEP))]
    assert np.allclose(np.maximum(chunks, 0), quality_net.pooled(net, body), atol=1e-3)
    high, where, windows = quality_net.pooled(net, body, True)
    assert np.allclose(np.take_along_axis(act, where, 0).clip(0), high, atol=1e-3) and (windows[where[0, 0]] == body[where[0, 0] : where[0, 0] + 8]).all()


def test_html_text(spark):
    model = html_text.train()
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp;amp; B</h1><p>First  <b>line\n here<p>Second<script>var x='<p>no</p>'</script></article><footer>&copy; x</footer>"
    assert html_text.extract(page, model) == "A &amp; B\nFirst line here\nSecond"
    right = 0
    for p in html_text.labelled_pages(200, 77):
        seen = re.sub(r"<!--.*?-->|<(script|style|title|textarea|select|button)\b.*?</\1>", " ", p, flags=re.S)
        want = re.findall(r"\bk[aeioulnrst]+", re.sub(r"<[^>]*>", " ", seen))  # all content words, in page order
        right += re.findall(r"\b[kq][aeioulnrst]+", html_text.extract(p, model)) == want
    assert right >= 190
    words = " ".join(f"word{i}" for i in range(24))
    assert html_text.extract(f"<article><h1>Hi there</h1><p>{words}</p><p>Details are in <a href=x>the full report</a> of the council.</p></article>", model) == f"Hi there\n{words}\nDetails are in the full report of the council."
    assert html_text.extract("<main><p>See <a href=x>this</a>.</p><table><tr><td>1<td>2</table></main>", model) == "See this.\n1\n2"
    assert html_text.extract(f"<body><p title=don't>{words}</p><p>Rest of it, don't</p>", model) == f"{words}\nRest of it, don't"
    assert html_text.extract("<body>Hello there</body>", model) == html_text.extract("Hello there", model) == "Hello there"
    assert html_text.extract("<article><p>x <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> y</p></article>", model) == "x E=mc y"
    deep = "<section>" + "<div>" * 40_000 + "<b>" * 8000 + "</section>" * 8000 + "</i>" * 9000 + "x"
    began = time.process_time()
    html_text.extract(deep, model)
    assert time.process_time() - began < 20
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p"), (3, "u", "x < y")], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html_text.extract_pages(rows, model).collect())[:2] == [0, 0]
    assert html_text.extract_pages(rows.limit(0), model).count() == 0


def test_html_keeps_formulas_unclosed_elements_and_late_names():
    text = lambda page: "".join(t or "" for _, t in html_text.parse(page).pieces)
    assert text("<p>a<math><mi>x</mi><annotation>\\\\x</annotation></math>b<object data=f>fall<b>back</b></object>c") == "axbfallbackc"
    assert text("<p>a<button>Go<p>b<svg><p>c<canvas><p>d") == "aGobcd" and text("<p>a<button>Go</button>b<svg>t</svg>") == "ab"
    assert text("<p>a<script>x<p>b") == "a"
    long = " ".join(f"u-{i}" for i in range(300))
    at = len(html_text.TAGS) + 1 + [n for n, _ in html_text.NAME_HINTS].index("side")
    assert html_text.node_features(html_text.parse(f"<div class='{long} sidebar'>x</div>"))[1, at] == 1


def test_messages_against_enumeration():
    rng = np.random.default_rng(5)
    tree = html_text.parse("<div><p>a<b>c</b></p><ul><li>d</li></ul></div>")
    n = len(tree.tags)
    unary, pair = rng.normal(size=n), rng.normal(size=(5, 2, 2))
    model = html_text.Model(np.zeros(html_text.N_FEATURES), pair)
    total, on = 0.0, np.zeros(n)
    for mask in range(1 << n):
        x = [mask >> i & 1 for i in range(n)]
        w = np.exp(sum(unary[i] * x[i] for i in range(n)) + sum(pair[html_text._kind(tree.tags[i], ""), x[tree.parent[i]], x[i]] for i in range(1, n)))
        total += w
        on += w * np.array(x)
    assert np.allclose(html_text.marginals(tree, model, unary), on / total)


@pytest.mark.parametrize("rounds", [0, 2])
def test_prefix_filter_alone_finds_all_links(spark, rounds):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[:i] + [f"z{i}"] + words[i + 1 :])) for i in range(0, 100, 9)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds).collect()}
    assert got == brute.near_components(rows)
