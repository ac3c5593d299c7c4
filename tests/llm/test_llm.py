"""Operators against brute force, exact round trips and edge cases, on small tables."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

import corpus_pipeline
from stavework.llm import chat_format, fingerprints, gumbel_encode, html_text, licenses, mixing, near_dups, quality_rules, sharding, token_counts
from stavework.llm.common import TOKENIZERS, file_bytes
from stavework.llm.lattice import SENTINEL, Vocabulary

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"
ODD = [None, "", "a", "  ", "héllo wörld 🎉", "x " * 3000, "same words here now again and more", "same words here now again and more", "Released under the MIT License. GNU  General-Public license!", "line\nline\nline\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, f"s{i % 3}" if i % 4 else None, "extra") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6]], "doc_id long, text string, source string, n_chars string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


OPERATORS = [
    token_counts.count_tokens, gumbel_encode.sample_encode, fingerprints.compare_with_next, fingerprints.fingerprints, licenses.scan_licenses, sharding.shard,
    quality_rules.assess, quality_rules.keep_good, near_dups.near_duplicates, near_dups.keep_one, mixing.decide, mixing.mix,
]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_odd_and_empty(odd, empty, operator):
    n = operator(odd).count()
    if operator in (token_counts.count_tokens, fingerprints.compare_with_next, licenses.scan_licenses, sharding.shard, quality_rules.assess, near_dups.near_duplicates, mixing.decide):
        assert n == len(ODD) + 1
    assert operator(empty).count() == 0


def test_counts_equal_the_library(docs):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(file_bytes(MODEL))
    proto.trainer_spec.model_type = 1
    low = min(p.score for p in proto.pieces if p.score > SENTINEL)
    for p in proto.pieces:
        p.score = max(p.score, low)
        if "▁" in p.piece[1:]:
            p.type = 5
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [r.text for r in docs.collect() if len(r.text) < 800] + [t or "" for t in ODD if len(t or "") < 800]
    counts, _ = token_counts.Counter(file_bytes(MODEL)).count(texts)
    assert counts == [len(library.encode(t)) for t in texts]


def unigram_library():
    """The library's unigram encoder with the scores that Vocabulary uses; no piece is retyped."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(file_bytes(MODEL))
    proto.trainer_spec.model_type = 1
    low = min(p.score for p in proto.pieces if p.score > SENTINEL)
    for p in proto.pieces:
        p.score = max(p.score, low)
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


SPACED = ["a        b", "def f(a):\n    return a\n", "   lead", "trail     ", " " * 40, "x  y   z\n\n  - 1   2.5    |  3\n\t  end", "  \n  ", "é" + " " * 17 + "🎉  日本  語", "a▁ ▁b"]


def test_runs_of_spaces_count_as_in_the_library(spark, docs):
    library = unigram_library()
    rng = random.Random(4)
    texts = SPACED + [re.sub(" ", lambda _: " " * rng.choice([1, 1, 2, 3, 8, 20]), r.text[:500]) for r in docs.limit(50).collect()]
    out = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(library.encode(t)) for i, t in enumerate(texts)}


def test_runs_of_spaces_are_in_the_sampled_lattice():
    lattices = gumbel_encode.Lattices(file_bytes(MODEL), 0.0005)
    (own,) = gumbel_encode.sample_texts(["a    b"], np.array([1], np.uint64), lattices, 1000)
    pieces = {tuple(lattices.vocabulary.pieces[i] for i in gumbel_encode.token_ids(lattices, x[0])) for x in own}
    assert len(pieces) == len(paths(lattices.vocabulary, "▁a")) * len(paths(lattices.vocabulary, "▁▁▁▁b"))
    assert ("▁a", "▁▁▁▁", "b") in pieces and ("▁a", "▁▁▁", "▁b") in pieces


def paths(vocabulary, unit):
    """All segmentations of a unit with their scores."""
    a = vocabulary.arcs([unit])
    arcs = list(zip(a["start"].tolist(), a["end"].tolist(), vocabulary.arc_scores(a["id"]).tolist(), strict=True))

    def walk(at):
        if at == len(unit):
            return [((), 0.0)]
        return [((e, *rest), s + x) for b, e, s in arcs if b == at for rest, x in walk(e)]

    return walk(0)


def test_samples_follow_the_lattice():
    alpha, n = 0.0005, 4000
    lattices = gumbel_encode.Lattices(file_bytes(MODEL), alpha)
    every = paths(lattices.vocabulary, "▁there")
    z = math.fsum(math.exp(alpha * s) for _, s in every)
    found = gumbel_encode.sample_texts(["there"] * n, np.arange(n, dtype=np.uint64), lattices, 3)
    assert all(len({tuple(x[0]) for x in own}) == len(own) == min(3, len(every)) for own in found)
    assert all(own[0][2] >= own[1][2] >= own[2][2] for own in found)
    first, weight = Counter(), Counter()
    for own in found:
        first[round(own[0][1], 4)] += 1
        for x in own:
            weight[round(x[1], 4)] += math.exp(-x[3])
    for _, s in every:
        p = math.exp(alpha * s) / z
        if p > 0.01:
            key = min(first, key=lambda k: abs(k - math.log(p)))
            same = sum(math.exp(alpha * t) / z for _, t in every if abs(alpha * (t - s)) < 1e-4)
            assert abs(first[key] / n - same) < 4 * math.sqrt(same / n)
            # a segmentation's indicator over its inclusion probability has the mean 1
            kept = min(weight, key=lambda k: abs(k - math.log(p)))
            alike = sum(1 for _, t in every if abs(alpha * (t - s)) < 1e-4)
            assert abs(weight[kept] / n - alike) < 0.35 * alike


@pytest.mark.parametrize("alpha", [0.0005, 0.01, 0.1, 1.0])
@pytest.mark.parametrize("word", ["there", "of", "interest"])
def test_all_segmentations_are_found(alpha, word):
    lattices = gumbel_encode.Lattices(file_bytes(MODEL), alpha)
    every = paths(lattices.vocabulary, "▁" + word)
    (own,) = gumbel_encode.sample_texts([word], np.array([7], np.uint64), lattices, len(every) + 3)
    assert len({tuple(x[0].tolist()) for x in own}) == len(own) == len(every)
    assert all(a[2] >= b[2] for a, b in zip(own, own[1:], strict=False)) and all(x[3] == 0 for x in own)
    top = max(alpha * s for _, s in every)
    z = top + math.log(math.fsum(math.exp(alpha * s - top) for _, s in every))
    assert np.allclose(sorted(x[1] for x in own), sorted(alpha * s - z for _, s in every), atol=1e-6)


def test_a_small_store_changes_nothing(docs):
    texts = [r.text for r in docs.orderBy("doc_id").limit(30).collect()]
    results = []
    for store in (1000, 10**9):
        lattices = gumbel_encode.Lattices(file_bytes(MODEL), 0.0005, store)
        results.append([[(gumbel_encode.token_ids(lattices, x[0]).tolist(), *x[1:]) for x in own] for t in texts for own in gumbel_encode.sample_texts([t], np.array([3], np.uint64), lattices, 2)])
    assert results[0] == results[1]


def test_encoding_round_trip():
    lattices = gumbel_encode.Lattices(file_bytes(MODEL), 0.0005)
    texts = [t or "" for t in ODD] + ["tab\tand\nnewline ", " lead", "日本語 text"]
    for text, own in zip(texts, gumbel_encode.sample_texts(texts, np.arange(len(texts), dtype=np.uint64), lattices, 2), strict=True):
        assert {lattices.vocabulary.decode(gumbel_encode.token_ids(lattices, x[0])) for x in own} == {text}


def test_decoding_gives_whole_tables_back(spark, docs, odd):
    marked = spark.createDataFrame([(1, "a▁b ▁"), (2, None), (3, "")], "doc_id long, text string")
    for table in (docs, odd, marked):
        want = Counter((r.doc_id, hashlib.sha256((r.text or "").replace("▁", " ").encode()).hexdigest()) for r in table.collect())
        out = gumbel_encode.sample_encode(table).withColumn("text", gumbel_encode.decode_ids(F.col("piece_ids"), file_bytes(MODEL))).collect()
        assert Counter((r.doc_id, r.decoded_sha256) for r in out if not r["sample"]) == want
        assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.gives_back == (not r.n_marks) for r in out)
    assert {(r.doc_id, r.gives_back, r.n_marks) for r in out} == {(1, False, 2), (2, True, 0), (3, True, 0)}
    null = spark.range(1).select(gumbel_encode.decode_ids(F.lit(None).cast("array<int>"), file_bytes(MODEL)).alias("x"))
    assert null.first().x is None


def test_automaton_and_hashes_find_the_same_pieces(docs):
    v = Vocabulary(file_bytes(MODEL))
    units = sorted(set().union(*(v.units_of(r.text) for r in docs.limit(40).collect())))
    a, b = v.arcs(units), v.arcs(units, automaton=False)
    assert set(zip(a["start"], a["id"], strict=True)) == set(zip(b["start"], b["id"], strict=True))


def test_fingerprints(docs):
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    for r, text, after in zip(sorted(fingerprints.compare_with_next(docs).collect(), key=lambda r: r.doc_id), texts, [*texts[1:], texts[0]], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        same = next((i for i, (x, y) in enumerate(zip(text, edited, strict=False)) if x != y), min(len(text), len(edited)))
        assert r.prefix_edited == same


def test_span_equality():
    x = fingerprints.code_points("abcabcabcd" * 5)
    h = fingerprints.PrefixHash(x)
    for i in range(0, 40, 3):
        for j in range(0, 40, 7):
            assert h.same(i, h, j, 9) == (x[i : i + 9].tolist() == x[j : j + 9].tolist())
    assert h.common_extension(0, h, 10) == 40


def test_licenses(docs, odd):
    for table in (docs, odd):
        rows = table.collect()
        out = licenses.scan_licenses(table).collect()
        want = Counter()
        for r in rows:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            at = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            starts = [i for i, _ in at]
            want[r.doc_id, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))] += 1
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == want


def test_sharding(docs, odd):
    for table in (docs, odd):
        rows, text = sharding.shard(table, 7).collect(), {r.doc_id: r.text or "" for r in table.collect()}
        assert all(r["size"] == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
        assert sorted(r.position for r in rows) == sorted(r.row_number for r in rows) == list(range(len(rows)))
        by = Counter(r.shard for r in rows)
        assert max(by.values()) - min(by.get(i, 0) for i in range(7)) <= 1
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in by.items())
    assert sharding.shard(docs.repartition(5), 7).orderBy("doc_id").collect() == sharding.shard(docs, 7).orderBy("doc_id").collect()


def test_quality_rules(spark, docs, odd):
    for table in (docs, odd):
        text = Counter()
        for r in table.collect():
            t = r.text or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
            text[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)] += 1
        out = quality_rules.assess(table).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == text
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in out)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    verdicts = [(labels[r.doc_id], r.kept or r.base_failed, r.kept) for r in quality_rules.assess(docs).collect() if r.doc_id in labels]
    assert all(passed for good, passed, _ in verdicts if good)
    assert sum(not kept for good, _, kept in verdicts if not good) >= 0.8 * sum(not good for good, _, _ in verdicts)


def test_expectation_maximisation_finds_the_rates():
    """Texts drawn from known rates: share, error rates and posteriors come out near the true ones."""
    rng = np.random.default_rng(8)
    on_bad, on_good = rng.uniform(0.5, 0.9, len(quality_rules.RULES)), rng.uniform(0.03, 0.15, len(quality_rules.RULES))
    is_good = rng.random(20_000) < 0.8
    votes = np.where(rng.random((20_000, len(on_bad))) < np.where(is_good[:, None], on_good, on_bad), quality_rules.BAD, quality_rules.GOOD)
    votes[rng.random(votes.shape) < 0.1] = quality_rules.ABSTAIN
    share, rates = quality_rules.estimate(list(Counter(map(tuple, votes.tolist())).items()))
    assert abs(share - 0.8) < 0.01
    assert np.abs(np.array(rates)[:, 0] - on_bad).max() < 0.03 and np.abs(np.array(rates)[:, 1] - on_good).max() < 0.03
    for v in votes[:50].tolist():
        likelihood = [share, 1 - share]
        for x, (bad, good) in zip(v, rates, strict=True):
            if x != quality_rules.ABSTAIN:
                likelihood = [a * (r if x == quality_rules.BAD else 1 - r) for a, r in zip(likelihood, (good, bad), strict=True)]
        assert math.isclose(quality_rules.posterior(v, (share, rates)), likelihood[0] / sum(likelihood), rel_tol=1e-9)


def test_good_votes_can_outweigh_a_bad_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality_rules.assess(docs).collect()
    saved = [r for r in out if str(quality_rules.BAD) in r.votes and r.kept]
    lost = [r for r in out if str(quality_rules.BAD) in r.votes and not r.kept and not r.base_failed]
    assert saved and lost
    model = quality_rules.fit(quality_rules.features(docs))
    for r in out[:300]:
        assert math.isclose(r.p_good, quality_rules.posterior(tuple(map(int, r.votes)), model), rel_tol=1e-9, abs_tol=1e-12)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in out if r.doc_id in labels and not r.base_failed]
    assert sum(kept for good, kept in judged if good) >= 0.98 * sum(good for good, _ in judged)
    assert sum(not kept for good, kept in judged if not good) >= 0.95 * sum(not good for good, _ in judged)


def test_a_column_of_an_inner_name_passes(docs):
    for name, operator in (("_quality", quality_rules.keep_good), ("_r", near_dups.keep_one), ("_r", mixing.mix), ("_copies", mixing.mix), ("_copy", mixing.mix)):
        out = operator(docs.withColumn(name, F.lit("own")))
        assert out.columns == [*docs.columns, name] and {r[name] for r in out.collect()} == {"own"}


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_text.fit(pages)
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1].replace("<br>", " ")
        blocks = (html_text.html.unescape(re.sub("<[^>]+>", "", x)) for x in re.split(r"</?(?:p|h1)>", inner))
        assert html_text.extract(r.html, weights) == "\n\n".join(" ".join(x.split()) for x in blocks if x.split())
    page = "<body><header>Site</header><ul class=menu><li><a>Home</a></ul><div><p>First words of the text.</p><div class='ad'>buy</div><p>More &amp; <b>more</b> words here.</p></div><div id=comments><p>I like it</p></div></body>"
    assert html_text.extract(page, weights) == "First words of the text.\n\nMore & more words here."
    odd = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>a<p>b")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.main_texts(odd).collect()) == ["", "", "a\n\nb"]


@pytest.mark.parametrize(
    "attributes",
    ['style="overflow:hidden"', 'title="hidden gems"', 'data-id="search"', 'data-role=navigation', 'class="layout no-sidebar"', "class='has-header'", 'id="widget-area" class="x"', "title='class=\"ad\" hidden'", 'data-hidden=1', 'aria-hidden="false"'],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers_keep_the_text_of_a_page(spark, attributes, tag):
    weights = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    page = f"<body><div {attributes}><{tag}><p>First words of the text are here.</p><div class=ad>buy</div><p>More words of it follow here.</p></{tag}><div class='sidebar'>see also</div></div></body>"
    assert html_text.extract(page, weights) == "First words of the text are here.\n\nMore words of it follow here."


def test_marked_and_hidden_parts_go(spark):
    weights = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    for attributes in ["hidden", "HIDDEN=''", "x=1 hidden", "aria-hidden=true", "class='b  ad'", "id=comments", "role = 'navigation'"]:
        page = f"<div><p>First words of the text are here.</p><div {attributes}><p>some other words</p></div><p>More words of it follow here.</p></div>"
        assert html_text.extract(page, weights) == "First words of the text are here.\n\nMore words of it follow here."
    related = "<main><p>First words of the text are here.</p></main><div class=related><article>one teaser</article><article>next teaser</article></div>"
    assert html_text.extract(related, weights) == "First words of the text are here."


@pytest.mark.parametrize("page", ["<div>" * 200_000, '<a "' * 200_000, '<a "' * 200_000 + ">", "<a b='" * 200_001 + ">", "<![CDATA[" * 200_000, "<p><b>x" * 100_000, "<i>" * 100_000 + "</u>" * 100_000, "<" * 300_000, "<!-- " * 200_000, "</div>" * 200_000, "<p class='" + "ad " * 200_000 + "'>x", "<script>" * 200_000])
def test_broken_and_nested_pages_take_linear_time(page):
    start = time.process_time()
    html_text.extract(page, html_text.Weights({}))
    assert time.process_time() - start < 10
    assert isinstance(html_text.extract(page[: len(page) // 50], html_text.Weights({})), str)


def test_the_region_is_the_best_of_all():
    """Scores of random token rows: no other contiguous run scores more than the one that extract takes."""
    rng = random.Random(6)
    weights = html_text.Weights({("text", "p", False, True): 500, ("text", "div", False, False): 500, ("tag", "p", False, True): 100, ("tag", "div", False, False): 100})
    for _ in range(200):
        parts = [f"<{t}>" + " ".join(f"w{i}x{k}" for k in range(rng.randrange(1, 12))) + f"</{t}>" for i, t in enumerate(rng.choices(["p", "div"], k=12))]
        items = html_text.tokens("".join(parts))
        gains = [weights.score("tag", what, dropped) if kind == "tag" else len(what.split()) * weights.score("text", context, dropped) for kind, what, context, dropped, _ in items]
        best = max(sum(gains[i:j]) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1))
        kept = {w for w in html_text.extract("".join(parts), weights).split()}
        if best <= 0:
            assert not kept
            continue
        at = [i for i, (kind, what, *_) in enumerate(items) if kind == "text" and set(what.split()) & kept]
        runs = (sum(gains[i:j]) for i in range(at[0] + 1) for j in range(at[-1] + 1, len(gains) + 1) if all(items[k][0] == "tag" for k in [*range(i, at[0]), *range(at[-1] + 1, j)]))
        assert abs(max(runs) - best) < 1e-9


def test_titles_histories_and_unicode_spaces(spark):
    weights = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    page = "<header>Site</header><article><header><h1>The title of it</h1></header><div class='social-history'><p>A&emsp;&nbsp;history\u2009of words in it.</p></div><p>More words of it follow here.</p></article><div class='social'>share</div>"
    assert html_text.extract(page, weights) == "The title of it\n\nA history of words in it.\n\nMore words of it follow here."


def jaccard_classes(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (both and both >= 0.8 * len(sets[i] | sets[j])) or (texts[i] or "") == (texts[j] or ""):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark, docs):
    rng = random.Random(3)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for _ in range(40):  # near copies with one word changed
        copy = list(base)
        copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 30 + [None, "", "one two", "one two"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sorted(near_dups.near_duplicates(table).collect(), key=lambda r: r.doc_id)
    assert [r.class_id for r in out] == jaccard_classes(texts)
    sizes = Counter(r.class_id for r in out)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in out)
    assert near_dups.keep_one(table).count() == len(sizes)


def test_weighted_samples_estimate_the_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(1 << 62, size=400).astype(np.uint64)
    sampler = near_dups.Sampler()
    w = rng.random(400) * 3 + 0.1
    v = np.where(rng.random(400) < 0.1, w * 2, w)
    exact = near_dups.weighted_jaccard((np.sort(h), w[np.argsort(h)]), (np.sort(h), v[np.argsort(h)]))
    _, a, _ = sampler.bands(np.zeros(400, np.int64), h, w)
    _, b, _ = sampler.bands(np.zeros(400, np.int64), h, v)
    assert abs((a == b).mean() - exact**near_dups.ROWS) < 0.4


def test_chat_format(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").unionByName(chat_format.tricky_conversation(spark))
    odd = spark.createDataFrame([(10**6, 0, None, None), (10**6, None, "assistant", "a <|im_end|> <\\| b"), (10**6, 0, "ro\nle\\n", "x"), (None, 1, "assistant", "é"), (None, 1, "assistant", "é")], turns.schema)
    turns = turns.unionByName(odd)
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    out = chat_format.read_back(chat_format.format_chats(turns)).collect()
    assert len(out) == len(by)
    for r in out:
        own = sorted(by[r.conv_id])
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        learned = "".join(text for _, _, role, text in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_mixing(docs):
    rows = mixing.decide(docs).collect()
    text, source = ({r.doc_id: r[c] for r in docs.collect()} for c in ("text", "source"))
    size, target, taken = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left = {}, set(names)
    while True:  # share by weight, set full sources aside, share again
        rest = sum(size.values()) - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if share[s] > 3 * size[s]}
        if not full:
            want |= share
            break
        want |= {s: 3 * size[s] for s in full}
        left -= full
    longest = {s: max(r["size"] for r in rows if source[r.doc_id] == s) for s in names}
    for s in names:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= longest[s]
    assert {(r.doc_id, r.taken) for r in mixing.decide(docs).collect()} == {(r.doc_id, r.taken) for r in rows}
    assert mixing.mix(docs).count() == sum(r.copies for r in rows)


def test_a_key_on_many_rows_spreads_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = [(i, None if i % 3 else 7, "s", i % 50, i if i < 6000 else 0, 9000) for i in range(8000)] + [(8000 + i, None, "s", 0, 42, 9000) for i in range(1000)]
    table = spark.createDataFrame(rows, "r long, k long, source string, size long, h long, documents long")
    out = mixing.dealt(table, 5).collect()
    assert sorted(r.r for r in out) == list(range(9000)) and len({r.draw for r in out}) == 9000
    blocks = Counter(r.block for r in out)
    assert len(blocks) == 141 and max(blocks.values()) < 2 * 64
    other = mixing.dealt(table.withColumn("r", F.lit(9000) - F.col("r")).repartition(7), 5).collect()
    assert Counter((r.k, r["size"], r.h, r.draw, r.block) for r in other) == Counter((r.k, r["size"], r.h, r.draw, r.block) for r in out)


def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(5)
    sizes, parts = rng.integers(1, 500, 60), rng.random(60)
    mean = np.zeros(60)
    for _ in range(4000):
        out = mixing.pivot(sizes, parts, rng.random(60))
        assert abs((sizes * out).sum() - (sizes * parts).sum()) < 1e-4
        assert ((out > 0) & (out < 1)).sum() <= 1
        mean += out / 4000
    assert np.abs(mean - parts).max() < 0.05


def test_differences_lose_no_pair():
    """For texts around a leader, and any order of keys: a similar pair that the leader does not join shares a key that is in neither's last part."""
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(1, 1 << 62, 400).astype(np.uint64))
    weight = dict(zip(pool.tolist(), rng.choice([0.4, 0.9, 1.0], len(pool)), strict=True))
    leader = np.sort(rng.choice(pool, 60, replace=False))

    def weighed(h):
        return h, np.array([weight[x] for x in h.tolist()]) * (1 + (h % np.uint64(7) == 0))

    texts = [weighed(leader)]
    for _ in range(150):
        h = set(texts[rng.integers(len(texts))][0].tolist())
        n = int(rng.integers(1, 12))
        h -= set(rng.choice(sorted(h), min(n, len(h) - 1), replace=False).tolist())
        texts.append(weighed(np.array(sorted(h | set(rng.choice(pool, int(rng.integers(0, 12))).tolist())), np.uint64)))
    found = [near_dups.differences(x, texts[0]) for x in texts]
    order = {k: rng.random() for f in found for k in f[0].tolist()}
    parts = []
    for keys, amounts, near, first, second in found:
        place = np.argsort([order[k] for k in keys.tolist()]) if len(keys) else np.zeros(0, int)
        rest = np.cumsum(amounts[place][::-1])[::-1]
        parts.append(({k: r for k, r in zip(keys[place].tolist(), rest.tolist(), strict=True)}, near, first, second))
    pairs = 0
    for i, (x, x_near, x_first, x_second) in enumerate(parts):
        assert x_near == (near_dups.weighted_jaccard(texts[i], texts[0]) >= near_dups.LEAST)
        for j, (y, y_near, y_first, y_second) in enumerate(parts):
            if i == j or y_near or near_dups.weighted_jaccard(texts[i], texts[j]) < near_dups.LEAST:
                continue
            pairs += 1
            bound = y_second if x_near else y_first
            need = (x_first + x_second + y_first + y_second) / 2
            assert any(x[k] >= x_first and y[k] >= bound and min(x[k], y[k]) >= need for k in x.keys() & y.keys())
    assert pairs > 50


def test_chained_near_duplicates(spark):
    """A group of random edits of one text: its classes are those of brute force, through all rounds."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 12])):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**7)}"
        texts.append(" ".join(copy))
    for i in range(20):  # each differs a little from the one before, and by that more and more from the first
        copy = texts[-1].split(" ")
        copy[rng.randrange(200)], copy[rng.randrange(200)] = f"y{i}", f"z{i}"
        texts.append(" ".join(copy))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sorted(near_dups.near_duplicates(table).collect(), key=lambda r: r.doc_id)
    model = spark.sparkContext.broadcast((near_dups.document_frequencies(table), len(texts)))
    each = [near_dups.shingles(t.encode(), np.array([0, len(t)])) for t in texts]
    weighed = [(h, near_dups.weights(h, tf, *model.value)) for _, h, tf in each]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near_dups.weighted_jaccard(weighed[i], weighed[j]) >= near_dups.LEAST:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert len(set(root)) > 5
    assert [r.class_id for r in out] == root


def unsteady(docs, spark):
    """docs with its rows in another order, and so with other row numbers, at each reading."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        read.add(1)
        for b in batches:
            yield b.take(np.random.default_rng(int.from_bytes(os.urandom(8), "little")).permutation(b.num_rows))

    return docs.coalesce(1).mapInArrow(run, docs.schema), read


def test_plans_in_another_order_at_each_reading(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    root = dict(zip((r.doc_id for r in rows), jaccard_classes([r.text for r in rows]), strict=True))
    for _ in range(2):
        plan, read = unsteady(docs, spark)
        kept = near_dups.keep_one(plan).collect()
        assert sorted(root[r.doc_id] for r in kept) == sorted(set(root.values())) and read.value == 1
        plan, read = unsteady(docs, spark)
        assert near_dups.near_duplicates(plan).where("kept").count() == len(kept) and read.value == 1
        want = Counter({r.doc_id: r.copies for r in mixing.decide(docs).collect() if r.copies})
        plan, read = unsteady(docs, spark)
        assert Counter(r.doc_id for r in mixing.mix(plan).collect()) == want and read.value == 1


def test_pipeline(spark, docs):
    good = sorted(quality_rules.keep_good(docs).collect(), key=lambda r: r.doc_id)
    first = {}
    for r, x in zip(good, jaccard_classes([r.text for r in good]), strict=True):
        first.setdefault(x, r)
    copies = {r.doc_id: r.copies for r in mixing.decide(spark.createDataFrame(list(first.values()), docs.schema)).collect() if r.copies}
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out if r["sample"] == 0) == copies
    assert all(r.gives_back for r in out)
