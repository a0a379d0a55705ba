"""Every operator against plain Python, over a corpus of awkward rows; over an empty table; and its helpers by themselves."""

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from blocklens.llm import bpe, exact, htmltext, language, licenses, lines, mixing, quality, simhash, substrings, wordtable
from blocklens.llm.graphs import components
from blocklens.llm.hashing import Texts


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_counts_and_verdicts(docs, rows):
    measured = quality.measure(docs.select("doc_id", "text", "lang", "source", "kept"))
    from blocklens.session import cut_lineage
    measured = cut_lineage(measured)
    got = by_id(quality.judge(measured, quality.thresholds(measured)))
    want = plain.kept_by_quality([r[:4] for r in rows], quality.MARGINS, quality.PRIOR, quality.SPREADS)
    for r, kept in zip(rows, want):
        row, _ = plain.quality(r[1])
        assert {k: got[r[0]][k] for k in row} == row, r[0]
        assert got[r[0]]["kept"] == kept, r[0]
    assert any(want) and not all(want)


def test_quality_fences_of_small_and_large_groups(spark):
    """Groups of 5 and of 5,000: the large one has fences of its own, the small one leans on its language; repeated rows count one by one."""
    row = lambda k, source, rate: (k, "en", source, 100, 0, 0, 0, rate, 500)
    data = [row(k, "large", 3000 + k % 7) for k in range(5000)] + [row(5000 + k, "small", 0) for k in range(5)]
    data += [row(6000 + k, "plain", k % 5) for k in range(2000)]
    names = ["k", "lang", "source", "n_words", "n_repeat_words", "r_symbol", "r_dup", "r_repeat", "r_length"]
    measured = spark.createDataFrame(data, names).withColumn("r_upper", F.lit(0).cast("long"))
    got = {r["source"]: r for r in quality.thresholds(measured).collect()}
    assert got["plain"]["high_r_repeat"] == 2 + quality.MARGINS["r_repeat"]
    assert got["large"]["high_r_repeat"] == 3003 - 3003 % 10 + quality.MARGINS["r_repeat"]
    # 5 own rows at 0 and 50 of a language of which five sevenths lie at 3000: the quartiles are the language's
    assert got["small"]["high_r_repeat"] > 3000 + quality.MARGINS["r_repeat"]


def test_quality_repeats_with_equal_hash_prefixes(spark):
    # different windows whose kept hash bits are equal take the exact path, which is also that of texts of over 2 ** 24 words
    text = " ".join(f"w{i % 7}" for i in range(300)) + " " + " ".join(plain.words("a b c d e f a b c"))
    got = quality.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_repeat_words"] == plain.quality(text)[0]["n_repeat_words"]


def test_quality_stage_keeps_columns(docs, nothing):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.keep_good(nothing).count() == 0


def test_line_dedup(docs, rows, nothing):
    got = by_id(lines.remove_chunks(docs, counts=True))
    for r, (text, removed) in zip(rows, plain.line_dedup([(r[0], r[1]) for r in rows])):
        assert (got[r[0]]["text"], got[r[0]]["n_removed"], got[r[0]]["n_chars"]) == (text, removed, len(text)), r[0]
    assert sum(r["n_removed"] for r in got.values()) > 50
    assert lines.remove_chunks(docs).columns == docs.columns
    assert lines.remove_chunks(nothing).count() == 0


def test_line_dedup_ties_and_null_ids(spark):
    text = "\n".join(f"line {k} here" for k in range(40))
    got = lines.remove_chunks(spark.createDataFrame([(None, text), (7, text), (7, text), (3, text)], "doc_id long, text string"), counts=True).collect()
    removed = {r["doc_id"]: r["n_removed"] for r in got}
    assert len(got) == 4 and removed[3] == 0 and removed[7] > 0 and removed[None] == removed[7]


def test_exact_dedup(docs, rows, nothing):
    groups = defaultdict(list)
    norm = lambda t: __import__("re").sub(plain.SPACE + "+", " ", t or "")
    for r in rows:
        groups[norm(r[1])].append(r[0])
    for k in (1, 1024):  # with one counter the split takes the heaviest group only
        got = by_id(exact.assign(docs, k))
        assert len(got) == len(rows)
        for text, ids in groups.items():
            for d in ids:
                assert (got[d]["keep_id"], got[d]["group_size"], got[d]["kept"], bytes(got[d]["digest"]).hex()) == (min(ids), len(ids), d == min(ids), plain.sha(text))
    assert exact.drop_copies(docs).count() == len(groups)
    assert exact.drop_copies(docs).columns == docs.columns
    assert exact.assign(nothing).count() == 0


def test_exact_dedup_ties(spark):
    df = spark.createDataFrame([(None, "a  b"), (5, "a b"), (5, "a b"), (9, "a\tb"), (5, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    got = exact.assign(df)
    assert got.filter("kept").groupBy("digest").count().agg(F.max("count")).first()[0] == 1 and got.count() == 7
    assert sorted((r["doc_id"] or -1) for r in exact.drop_copies(df).collect()) == [-1, 5, 5]


def test_misra_gries_keeps_what_is_frequent():
    rng = np.random.default_rng(3)
    stream = np.concatenate([np.repeat(np.arange(5), 300), rng.integers(100, 10**6, 3000)])
    rng.shuffle(stream)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.array_split(stream, 40):
        keys, counts = exact.reduce_counters(np.concatenate([keys, part]), np.concatenate([counts, np.ones(len(part), np.int64)]), 20)
    assert set(range(5)) <= set(keys.tolist()) and len(keys) <= 20


def test_mixing(docs, rows, nothing):
    sized = docs.select("doc_id", "source", mixing.size_of().alias("size"))
    got, again = by_id(mixing.copies(sized)), by_id(mixing.copies(sized.repartition(3)))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(plain.words(r[1]))
    want = plain.targets(dict(sizes))
    for r in rows:
        g = got[r[0]]
        assert g["size"] == len(plain.words(r[1])) and g["source_size"] == sizes[r[3]] and math.isclose(g["target"], want[r[3]])
        assert g["copies"] in (math.floor(g["rate"]), math.floor(g["rate"]) + 1) and g["copies"] <= 3 and again[r[0]]["copies"] == g["copies"]
        taken[r[3]] += g["copies"] * g["size"]
    largest = max(len(plain.words(r[1])) for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    assert math.isclose(sum(want.values()), sum(sizes.values()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {d: g["copies"] for d, g in got.items() if g["copies"]}
    assert mixing.mix(nothing).count() == 0


def test_mixing_targets_need_resharing(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1000), ("c", 3), ("d", 400), (None, 50)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = plain.targets({"a": 5, "b": 1000, "c": 3, "d": 400, None: 50})
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s]) for s in want)


def test_simhash(docs, rows, nothing):
    got = by_id(simhash.group(docs))
    prints = {r[0]: plain.fingerprint(r[1]) for r in rows}
    roots = plain.components(prints)
    for d in prints:
        assert got[d]["fingerprint"] % 2**64 == prints[d] and got[d]["component_id"] == roots[d], d
    left = simhash.drop_near_copies(docs)
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == sorted(set(roots.values())) and left.columns == docs.columns
    assert simhash.group(nothing).count() == 0


def test_golay_keys_find_all_pairs_at_three_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for n in (1, 2, 3, 4):
            flip = 0
            for k in rng.choice(64, n, replace=False).tolist():
                flip |= 1 << k
            prints.add(b ^ flip)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()}
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 3}
    assert got == want and len(want) > 150


def test_golay_decodes_every_vector_within_three_bits():
    golay = simhash.Golay()
    words = {int(i) << 11 | int(golay.high[i]) for i in range(1 << 12)}
    assert min((a ^ b).bit_count() for a, b in combinations(sorted(words)[:300], 2)) >= 7
    v = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    code = golay.decode(v).astype(np.int64)
    assert all(((int(c) << 11 | int(golay.high[c])) ^ int(x)).bit_count() <= 3 for c, x in zip(code, v))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}


def test_substring_dedup(docs, rows, nothing):
    got = by_id(substrings.remove_repeats(docs))
    for d, (n, removed, digest) in plain.substring_dedup({r[0]: r[1] for r in rows}).items():
        assert (got[d]["n_words"], got[d]["n_removed"], plain.sha(got[d]["kept"])) == (n, removed, digest), d
    assert sum(r["n_removed"] for r in got.values()) > 2000
    assert substrings.remove_repeats(nothing).count() == 0


def test_substring_dedup_offsets_and_ties(spark, tmp_path):
    """Repeats of 49, 50, 51 and 75 words at every alignment, an interval pieced together from several documents, null and repeated ids."""
    base, docs = plain.prose(1, 400), {}
    docs[1] = " ".join(base)
    for k in range(30):
        n = (49, 50, 51, 75)[k % 4]
        docs[2 + k] = " ".join([*plain.prose(100 + k, k), *base[k * 7:k * 7 + n], *plain.prose(200 + k, 9)])
    docs[50] = " ".join([*plain.prose(301, 13), *base[100:160], *plain.prose(302, 3)])
    docs[51] = " ".join([*plain.prose(303, 2), *base[140:200], *plain.prose(304, 5)])
    docs[52] = " ".join(base[90:210])
    rows = [*docs.items(), (None, docs[52]), (52, docs[52])]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = substrings.remove_repeats(spark.read.parquet(path)).collect()
    want = plain.substring_dedup(docs)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], plain.sha(r["kept"])) == want[r["doc_id"]], r["doc_id"]


def test_window_hashes_depend_on_words_alone():
    texts = [b"a bb ccc a bb ccc dd", b"", b"  bb  ccc\ta ", b"x"]
    t = Texts(texts)
    assert (t.first == [0, 7, 7, 10, 11]).all()
    h = t.window(np.array([0, 3, 1, 7]), np.array([3, 3, 3, 3]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


def test_bpe_equals_library(docs, rows, nothing):
    got = by_id(bpe.digests(bpe.encode(docs)))
    for r in rows:
        assert (got[r[0]]["n_tokens"], got[r[0]]["ids_sha256"], got[r[0]]["decoded_sha256"]) == bpe.plain(r[1]), r[0]
    assert bpe.encode(nothing).count() == 0


def test_bpe_repeated_rows(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "other"), (2, None)], "doc_id long, text string").write.parquet(path)
    got = [(r["doc_id"], r["decoded"]) for r in bpe.decode(bpe.encode(spark.read.parquet(path))).collect()]
    assert Counter(got) == {(1, "same</w> text</w> here</w>"): 2, (None, "other</w>"): 1, (2, ""): 1}


@pytest.mark.parametrize("values", [[], [0], [127, 128, 16383, 16384, 2**31, 5], list(range(300))])
def test_packed_numbers(values):
    assert wordtable.unpack_numbers(wordtable.pack_numbers(np.array(values, np.int64))).tolist() == values


def test_language_model(docs, rows, nothing):
    got = by_id(language.score(docs))
    want = plain.unigrams({r[0]: r[1] for r in rows})
    for d, (held, n, known, train, base) in want.items():
        g = got[d]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held, n, known, train) and math.isclose(g["base_score"], base, rel_tol=1e-9), d
        assert g["score"] <= 1e-6
    assert language.score(nothing).count() == 0


def toy_model(words: int = 10) -> "language.Model":
    side, heads, tails = language.sizes(words)
    tokens = np.zeros(side * side, np.int64)
    tokens[:10] = 1000
    model = language.Model(side, tails, {}, tokens, np.ones(side * side, np.int64), 10000, words, [])
    model.params = language.initial(model)
    return model


def test_language_model_is_normalised_and_learns_order():
    """Class probabilities sum to one; on a stream with order the trained model beats its unigram start."""
    rng = np.random.default_rng(2)
    model = toy_model()
    classes = model.side ** 2
    texts = language.Stream((np.cumsum(rng.integers(1, 3, 20000)) % 10).astype(np.int64), np.array([12000, 8000]), classes)
    assert texts.contexts(np.array([0, 12000, 12001])).tolist() == [[classes] * 3, [classes] * 3, [texts.target[12000], classes, classes]]
    before = language.class_scores(model, texts).sum()
    squares = [np.zeros_like(p) for p in model.params]
    for at in range(0, 20000, 500):
        pick = at + np.argsort(texts.target[at:at + 500], kind="stable")
        inner = rng.integers(0, model.side, (model.side, language.INNER)) + np.arange(model.side)[:, None] * model.side
        language.train_step(model, squares, texts.contexts(pick), texts.target[pick], rng.integers(0, 2, language.NOISE), inner, model.log_noise())
    assert language.class_scores(model, texts).sum() > before + 500
    one = [language.class_scores(model, language.Stream(np.array([3, 4, k]), np.array([3]), classes))[2] for k in range(classes)]
    assert math.isclose(float((10.0 ** np.array(one, np.float64)).sum()), 1.0, rel_tol=1e-4)


def test_language_model_scores_equal_a_plain_softmax():
    """Batched, grouped products against one token at a time."""
    model, rng = toy_model(), np.random.default_rng(5)
    q, t, r, c = model.params
    t, bt, r, br = t[:, :-1], t[:, -1], r[:, :-1], r[:, -1]
    texts = language.Stream(rng.integers(0, 64, 300), np.array([100, 1, 199]), 64)
    got = language.class_scores(model, texts)
    for i, ctx in enumerate(texts.contexts(slice(None))):
        h = (q[ctx] * c).sum(axis=0).astype(np.float64)
        g, first = texts.target[i] // 8, texts.target[i] // 8 * 8
        top, inside = h @ t.T + bt, h @ r[first:first + 8].T + br[first:first + 8]
        want = top[g] - np.log(np.exp(top).sum()) + inside[texts.target[i] - first] - np.log(np.exp(inside).sum())
        assert math.isclose(got[i], want / math.log(10), abs_tol=1e-4)


def test_language_model_grows_with_the_vocabulary():
    assert [language.sizes(v) for v in (0, 10 ** 4, 10 ** 6, 10 ** 8)] == [(8, 47, 16), (10, 83, 16), (32, 767, 256), (100, 7951, 2048)]
    word = b"ending"
    assert language.tail_class(word, 64) == language.tail_class(word, 1024) % 64


def test_language_model_held_out_accuracy(spark):
    """On held-out documents of the tables the model's tokens are more probable than the unigram base's."""
    got = language.op8(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print("held out, a token:", got[0] / got[2], got[1] / got[2])
    assert got[0] > got[1] * 0.97


def test_license_scan(docs, rows, nothing):
    got = by_id(licenses.scan_licenses(docs))
    for r in rows:
        g = got[r[0]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == plain.licenses(r[1]), r[0]
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert "notice:apache-2.0" in got[0]["labels"] and "notice:mit" in got[0]["labels"]
    assert licenses.scan_licenses(nothing).count() == 0


def test_license_templates():
    import re
    automata = {k: licenses.compile_template(k, v) for k, v in {**licenses.NOTICES, **licenses.TEXTS}.items()}
    for label, template in licenses.TEXTS.items():
        full = re.sub(r"<<var \d+>>", "Some Holder", template).replace("<<opt>>", "").replace("<<end>>", "")
        bare = re.sub(r"<<opt>>(?:(?!<<opt>>|<<end>>).)*<<end>>", "", re.sub(r"<<opt>>(?:(?!<<opt>>|<<end>>).)*<<end>>", "", template, flags=re.S), flags=re.S)
        bare = re.sub(r"<<var \d+>>", "", bare)
        for text in (full, bare, "before, " + full.upper() + " and after"):
            assert label in licenses.scan(text, list(automata.values()))["labels"], (label, text[:80])
        anchor = automata[label].anchor.decode().split()
        broken = " ".join(full.split()).replace(" ".join(anchor), " ".join([*anchor[:5], "changed", *anchor[6:]]))
        assert label not in licenses.scan(broken, list(automata.values()))["labels"]
    toy = licenses.compile_template("toy", "a <<opt>> b <<opt>> c <<end>> <<end>> <<var 2>> d e")
    ends = lambda text: toy.accepts(text.encode().split(), 0)
    assert (ends("a d e"), ends("a b d e"), ends("a b c x y d e"), ends("a c d e"), ends("a x y z d e")) == (3, 4, 7, 4, None)
    assert ends("a d e d e") == 5


PAGES = [
    ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; more</h1><p>One\n two&nbsp;three <b>four.</b></p><script>x='</p>'</script><p>Five six seven"
     "<div class='ad'>buy this</div><p>eight nine ten</article><section class=comments><article class=comment><p>nice words here</p></article></section><footer>bye</footer></body></html>",
     "Head & more\nOne two three four.\nFive six seven\neight nine ten"),
    ("<body><div id=menu><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul></div><div class=post><p>Plain words make up this text and there are many of them.</p><ul><li>first item of list</li>"
     "<li>second item of list</li></ul></div><div class=sidebar><p>Not this one</p></div></body>", "Plain words make up this text and there are many of them.\nfirst item of list\nsecond item of list"),
    ("", ""), (None, ""), ("just words without any tag", "just words without any tag"), ("<p>never closed <!-- gone", "never closed"),
    ("<div class=a title=\"x > y\">quoted bracket stays out</div>", "quoted bracket stays out"), ("<nav>only menu</nav>", ""), ("<p>İstanbul <script>1</script>after</p>", "İstanbul after"),
]


def test_main_text_of_pages(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(None, "n", "<p>some words</p>")], "page_id long, url string, html string")
    from blocklens.session import ship_package
    ship_package(spark)
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(df).collect()}
    assert [got[i] for i in range(len(PAGES))] == [t for _, t in PAGES] and got[None] == "some words"
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_main_text_of_the_tables(spark):
    """The tables' pages mark their articles: a plain reading of that element is the whole answer."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in htmltext.op1(spark, "/root/testdata/sf0.001").collect():
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1])]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_long_page_and_long_attribute():
    weights = htmltext.weights_from(sum((htmltext.counts(e) for e in htmltext.EXAMPLES), Counter()))
    page = "<body>" + "<p>some plain words of a paragraph</p>" * 20000 + "<a title='" + "x" * 10**6 + "'>"
    assert htmltext.extract(page, weights) == "\n".join(["some plain words of a paragraph"] * 20000)
