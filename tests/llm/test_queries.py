"""The registered queries, on tables of sf0.001 with odd rows added, against plain versions of what they return."""

import base64
import hashlib
import html
import random
import re
import shutil
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlink.llm import language_id, license_scan, mixing, near_dup, quality_net, warc
from spanlink.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables of sf0.001; documents with nulls, blanks, a long text, near copies, a benchmark passage and a license."""
    d = tmp_path_factory.mktemp("sf")
    for name in ("labels", "benchmark", "pages"):
        shutil.copy(f"{SF}/{name}.parquet", d / f"{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    some = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    long = next(t for t in some if len(t.split()) > 200)
    words = long.split()
    odd = [
        (90_000, None, "en", "src0", 0), (90_001, "", None, None, 0), (90_002, " \n\t ", "fr", "src1", 3), (90_003, "1 2 3 !", "en", "src0", 7), (90_004, " ".join(some), "en", "src2", 1),
        (90_005, " ".join([*words[:80], "changed", *words[81:]]), "en", "src0", 1), (90_006, f"{some[1]} {item} {some[2]}", "en", "src0", 1),
        (90_007, "Some words first. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files; MIT License.", "en", None, 1),
    ]
    # in one file, as the driver's tables are
    docs.unionByName(spark.createDataFrame(odd, DOCS)).coalesce(1).write.parquet(str(d / "documents.parquet"))
    return str(d)


def texts(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, sf, monkeypatch):
    seen, fit = {}, language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda counts, order: seen.update(counts) or fit(counts, order))
    docs, out = texts(spark, sf), QUERIES["op1_language_id"](spark, sf).collect()
    assert len(out) == len(docs)
    learned = set(language_id.tokens(" ".join(r["text"] for i, r in docs.items() if r["text"] and r["lang"] and crc(i, 3) != 1)))
    assert set().union(*seen.values()) <= learned
    alphabet = {c for words in seen.values() for w in words for c in w} | {"\x03"}
    costs = {lang: brute.kneser_ney(words, alphabet) for lang, words in seen.items()}
    known: dict = {}
    for r in out:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        if not text or not re.search(r"[^\W\d_]", text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        words, total = Counter(language_id.tokens(text)), {}
        for lang, cost in costs.items():
            total[lang] = sum(n * _once(known, lang, w, cost) for w, n in words.items())
        assert r["lang_pred"] == min(sorted(total), key=lambda x: round(total[x], 2))
    right = [docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in out if r["held_out"] and docs[r["doc_id"]]["lang"] and docs[r["doc_id"]]["text"]]
    assert sum(right) >= 0.97 * len(right)


def _once(known, lang, word, cost):
    if known.get((lang, word)) is None:
        known[lang, word] = cost(word)
    return known[lang, word]


def test_op1_ties_and_rejection():
    model = language_id.fit({"a": Counter({"same": 3}), "b": Counter({"same": 3})})
    assert language_id.Scorer(model).predict(["same"])[0] == ["a"]
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeiou" if i % 2 else "bdklmnrst") for i in range(rng.randint(3, 8))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(80))
    model = language_id.fit({"x": Counter(" ".join(text() for _ in range(60)).split())})
    texts = [text() for _ in range(40)]
    language_id.calibrate(model, texts + ["zzzz qqqq xxxx"], ["x"] * 41)  # one odd text does not move the limit
    assert language_id.Scorer(model).predict([texts[0], "Съешь же ещё этих мягких булок", "zqxv vvqz wxzq zzqx"])[2] == [False, True, True]


class Article(HTMLParser):
    """Text blocks inside article elements of well-formed enough pages."""

    BLOCKS = {"p", "h1", "h2", "h3", "article", "ul", "li", "div", "table", "tr", "td"}

    def __init__(self):
        super().__init__()
        self.depth, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1] += data


def test_op2(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = QUERIES["op2_html_text"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        p = Article()
        p.feed(pages[r["page_id"]]["html"] or "")
        p.close()
        want = "\n".join(b for b in (re.sub(r"\s+", " ", x).strip() for x in p.blocks) if b)
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == pages[r["page_id"]]["url"]
    assert html.unescape("&amp;") == "&"


def test_op3(spark, sf):
    docs = texts(spark, sf)
    want = brute.near_components([(i, r["text"]) for i, r in docs.items()])
    out = {r["doc_id"]: r for r in QUERIES["op3_minhash"](spark, sf).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.values())


@pytest.mark.parametrize("hot", [2, 512])
def test_op3_hot_groups(spark, monkeypatch, hot):
    """A large group of copies, a hub with many near copies, and a chain: the same result however they are split."""
    monkeypatch.setattr(near_dup, "HOT", hot)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(30)] + [(100 + i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(40)] + [(500 + i, " ".join(f"v{j}" for j in range(i, 60 + i))) for i in range(0, 20, 2)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near_components(rows)


def test_op4(spark, sf):
    docs = texts(spark, sf)
    out = QUERIES["op4_license_scan"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]]["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = sorted((i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        more, covered = brute.license_labels(words, license_scan.TEMPLATES)
        base = {label for _, label in places}
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | more))
        assert r["score"] == pytest.approx(1.0 if places else covered)


def test_op6(spark, sf, monkeypatch):
    seen, fit = [], quality_net.fit
    monkeypatch.setattr(quality_net, "fit", lambda bodies, labels, **o: seen.append((bodies, fit(bodies, labels, **o))) or seen[-1][1])
    docs, out = texts(spark, sf), QUERIES["op6_quality_net"](spark, sf).collect()
    bodies, net = seen[0]
    assert len(out) == len(docs) and {bytes(b) for b in bodies} <= {(r["text"] or "").encode() for i, r in docs.items() if crc(i, 5)}
    for r in out:
        assert r["held_out"] == (crc(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] % 10 == 0:  # filter by filter, window by window
            body = np.frombuffer((docs[r["doc_id"]]["text"] or "").encode().ljust(8, b"\0"), np.uint8)
            act = np.stack([net.embed[body[i : i + 8]].reshape(-1) @ net.conv + net.bias for i in range(len(body) - 7)]).clip(0)
            top = np.stack([act[at : at + quality_net.CHUNK - 7].max(axis=0) for at in range(0, len(act), quality_net.CHUNK - 7)])
            logit = np.concatenate([top.mean(axis=0), top.max(axis=0)]) @ net.out + net.base[0]
            assert r["score"] == pytest.approx(1 / (1 + np.exp(-(net.slope * logit + net.shift))), abs=1e-3)


def test_op6_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r["quality"] is not None}
    out = [r for r in QUERIES["op6_quality_net"](spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in out if labels[r["doc_id"]] == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.95


def test_op6_long_text_in_the_sample(spark):
    rows = [(i, ("good words in a row " if i % 2 else "### $$$ %%% ") * (4000 if i == 1 else 30)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    net = quality_net.train(docs, labels, epochs=2)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in quality_net.score(docs, net).collect())
    assert quality_net.train(docs, labels, sample_bytes=10).constant == 0.5


@pytest.mark.parametrize("file_bytes,range_rows", [(8 << 20, 50_000), (2000, 7)])
def test_op7(spark, sf, monkeypatch, file_bytes, range_rows):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(warc.capture_index, "__defaults__", (range_rows,))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(70_000, "http://big.example.org/", "x" * 300_000), (70_001, "http://big.example.org/", None), (70_002, "http://a.example.org/", None), (70_003, None, "y")], "page_id long, url string, html string")
    rows = pages.unionByName(more).collect()
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault((r["html"] or "").encode(), r["page_id"])
    want = {}
    for r in rows:
        body = (r["html"] or "").encode()
        revisit = first[body] != r["page_id"]
        want[r["page_id"]] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[body] if revisit else None)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out} == want
    order = [(r["url_key"].encode(), r["time"], r["page_id"]) for r in out]
    assert order == sorted(order) and (file_bytes > 2000 or len({r["run"] for r in out}) > 10)


def test_op7_runs_out_of_order_raise(spark):
    rows = [("http://b.org/", "t", 1, "r", 0), ("http://a.org/", "t", 2, "r", 1)]
    with pytest.raises(Exception, match="not in order"):
        warc.capture_index(spark.createDataFrame(rows, "url string, time string, page_id long, run string, offset long")).collect()


def test_op8(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, r in sorted(texts(spark, sf).items()):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op8_token_files"](spark, sf).collect()) == want


def test_op10(spark, sf):
    docs, out = texts(spark, sf), QUERIES["op10_mixing"](spark, sf).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    by = Counter()
    for i, r in docs.items():
        by[r["source"]] += size[i]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    left, free, target = float(sum(by.values())), list(range(len(names))), {}
    while free:  # the contract's rule, source by source
        weight = {i: (5, 2, 1)[i % 3] for i in free}
        share = {i: left * weight[i] / sum(weight.values()) for i in free}
        full = [i for i in free if share[i] > 3 * by[names[i]]]
        for i in full or free:
            target[names[i]] = 3.0 * by[names[i]] if full else share[i]
        left -= sum(target[names[i]] for i in full)
        free = [i for i in free if full and i not in full]
    taken = Counter()
    for r in out:
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], by[s]) and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(out) == len(docs) and all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 5 for s in names)
    again = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in out}


def test_apportionment_within_limits():
    rng = np.random.default_rng(6)
    for _ in range(30):
        votes, seats, limit = rng.integers(1, 50, 6).astype(float), int(rng.integers(0, 40)), rng.integers(0, 9, 6)
        want = np.zeros(6, int)
        for _ in range(min(seats, int(limit.sum()))):
            want[int(np.argmax(np.where(want < limit, votes / (2 * want + 1), -1)))] += 1
        got = mixing.apportion(votes, seats, limit)
        assert got.sum() == want.sum() and (got <= limit).all()
        assert np.allclose(sorted(votes / (2 * got + 1)), sorted(votes / (2 * want + 1)))


def test_mixing_refuses_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(spark.createDataFrame([(i, "a b", f"s{i}") for i in range(3)], "doc_id long, text string, source string"))


def test_pipeline(spark, sf):
    """Each stage on its own input, against plain versions; nulls, repeated ids and empty tables too."""
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = [r["text"] for r in docs.where("length(text) > 600").orderBy("doc_id").limit(4).collect()]
    more = [(None, some[0], "en", "src0", 1), (None, some[1] + " " + items[0], "en", "src0", 1), (95_000, some[2] + " one more word", "en", "src1", 1), (95_001, some[3], "en", "src1", 1), (95_001, items[1], "en", "src1", 1), (95_002, "Съешь же ещё этих мягких французских булок, да выпей чаю", None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(more, DOCS)).withColumn("row", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r["doc_id"], r["text"])
    rows = lambda df: [key(r) for r in df.collect()]

    kept = stages["language"](spark, docs, sf)
    assert kept.columns == docs.columns
    gone = set(rows(docs)) - set(rows(kept))
    assert (95_002, more[-1][1]) in gone and all(not t or not re.search(r"[^\W\d_]", t) or i == 95_002 for i, t in gone)

    kept = stages["near_dedup"](spark, docs, sf)
    numbered = list(enumerate(sorted(rows(docs), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))))
    groups = brute.near_components([(n, t) for n, (_, t) in numbered], 80)
    want = Counter(numbered[n][1] for n, (_, c) in groups.items() if n == c)
    assert Counter(rows(kept)) == want and kept.columns == docs.columns

    kept = stages["decontaminate"](spark, docs, sf)
    assert Counter(rows(kept)) == Counter(x for x in rows(docs) if not any(brute.contained(x[1], item) for item in items))

    mixed = stages["mix"](spark, docs, sf)
    plan = {(r["doc_id"], r["row"]): r for r in mixing.mix(docs).collect()}
    copies = Counter()
    for r in plan.values():
        copies[r["doc_id"]] += (2 * r["taken"] + r["size"]) // (2 * r["size"]) if r["size"] else 0
    assert Counter(r["doc_id"] for r in mixed.where("doc_id not in (95001)").collect()) == Counter({i: n for i, n in copies.items() if n and i is not None and i != 95_001})

    tokens = stages["tokens"](spark, docs, sf).collect()
    assert len(tokens) == docs.count() and max(r["start"] + r["n_tokens"] for r in tokens) == sum(r["n_tokens"] for r in tokens)
    for name, stage in stages.items():
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0 and (name == "tokens" or empty.columns == docs.columns)


def test_pipeline_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert rows and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert 90_006 not in {r["doc_id"] for r in rows} and 90_000 not in {r["doc_id"] for r in rows}
