import dataclasses
import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import decontaminate, html_extract, langid, packing, queries, repeats, secrets, simhash, toxicity


# Language identification ---------------------------------------------------------------------------------------------


def plain_code_length(texts, data):
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        t = b"\n\n\n" + t
        for i in range(3, len(t)):
            for k in range(4):
                counts[k][t[i - k : i]][t[i]] += 1
    data, total = b"\n\n\n" + data, 0.0
    for i in range(3, len(data)):
        excluded = set()
        for k in (3, 2, 1, 0):
            seen = counts[k].get(data[i - k : i])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            size = sum(left.values()) + len(left)
            if data[i] in left:
                total += math.log2(size / left[data[i]])
                break
            if left:
                total += math.log2(size / len(left))
            excluded |= set(seen)
        else:
            total += math.log2(256 - len(excluded))
    return total


def test_code_lengths_are_exact():
    rng = random.Random(0)
    texts = [bytes(rng.choice(b"abcd e") for _ in range(300)) for _ in range(5)]
    path, n = np.unique(np.concatenate([langid.grams(t) for t in texts]), return_counts=True)
    scorer = langid.Model(["x"], [path], [n]).scorer()
    for data in ("abc dead beef", "xyz", "é zab", "a"):
        assert scorer.bits(data)[0] == pytest.approx(plain_code_length(texts, data.encode()), rel=1e-5)


def test_what_has_no_letter_is_undetermined():
    path, n = np.unique(langid.grams(b"some words"), return_counts=True)
    scorer = langid.Model(["x"], [path], [n]).scorer()
    assert [scorer.predict(t)[0] for t in ("\u00b2\u00bd \u00b2", "\u2167 12 _", "\u0663", "\u00aa", "\u5b57", "a1")] == ["und", "und", "und", "x", "x", "x"]


def test_a_bounded_sample_of_labelled_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i} text", "en" if i % 10 else "de") for i in range(3000)], "doc_id long, text string, lang string")
    whole, sample = langid.train(docs), langid.train(docs, max_rows=500)
    share = sum(sample.counts[1]) / sum(whole.counts[1])
    assert whole.languages == sample.languages == ["de", "en"]
    assert (sample.counts[0].sum() == whole.counts[0].sum()) and 0.2 < share < 0.36


def test_languages(spark, awkward, no_documents, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries.op2_ppm(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    model = langid.train(awkward)
    got = langid.predict(awkward, model).collect()
    assert len(got) == 10
    assert [r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 7, 8)] == ["und"] * 4
    assert langid.predict(no_documents, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward, langid.train(no_documents)).collect()} == {"und"}


# HTML ----------------------------------------------------------------------------------------------------------------


def test_pages(spark, sf_dir):
    import html

    for row in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:h1|p|br)>", " ", inside).replace("<b>", "")).split())
        assert row["text"] == want and row["n_chars"] == len(want)


def test_page_without_article_element():
    page = """<html><body><div class="site-header">Logo</div><div id="cookie-notice">We use cookies, fine?</div><div><div class="sidebar"><p>Side text, long and full of words, that goes on.</p></div>
    <div class="content"><h2>Title</h2><p>First &eacute; paragraph with a <a href=x>link</a> in it, and more.<p>Second<br>one.<ul><li>a<li>b</ul><form><input><p>Search this, now.</p></form><div class="comments"><p>Great post, thanks, really!</p></div></div></div>
    <div class=footer>(c) 2020, all rights.</div></body></html>"""
    assert html_extract.main_text(page) == "Title First é paragraph with a link in it, and more. Second one. a b"


PARAGRAPHS = "<p>First long paragraph, with commas, and words that go on for a while. More of it, too.</p>" * 3
PLAIN = " ".join(["First long paragraph, with commas, and words that go on for a while. More of it, too."] * 3)


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<p><a href=y>A fully linked sentence of the article.</a></p>", " A fully linked sentence of the article."),
        ("<div class='related-work'><h2>Related work</h2><p>Others did it before us, as is known, and wrote it down. They did.</p></div>", " Related work Others did it before us, as is known, and wrote it down. They did."),
        ("<ul><li>one<li>two</ul>", " one two"),
        ("<ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>About</a></ul>", ""),
        ("<div class=comments><p>Great post, really, thanks a lot! " + "Long words, more of them. " * 60 + "</p></div>", ""),
        ("<div class='ad'>Buy now.</div><form><p>Your name, please.</p></form><div hidden>Not seen, ever.</div>", ""),
        ("<div class='share'><a href=x>Tweet</a> <a href=y>Post</a></div>", ""),
    ],
)
@pytest.mark.parametrize("element", ["article", "div"])
def test_inside_an_article(element, inside, text):
    page = f"<html><body><nav><a href=x>Home</a></nav><{element}><h1>Title here</h1>{PARAGRAPHS}{inside}</{element}><div class=sidebar><p>Aside, of no use.</p></div><footer>The end.</footer></body></html>"
    assert html_extract.main_text(page) == "Title here " + PLAIN + text


def test_path_ratios_decide(spark, sf_dir, monkeypatch):
    """Without names and semantic tags most pages keep their text, and with constant ratios hardly any does."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    texts = [html_extract.main_text(p) for p in pages]
    bare = [re.sub(r"<(/?)(nav|article|footer)>", r"<\1div>", re.sub(r' class="[^"]*"', "", p)) for p in pages]
    assert sum(html_extract.main_text(p) == t for p, t in zip(bare, texts, strict=True)) > 0.8 * len(pages)
    ratios = html_extract.path_ratios
    monkeypatch.setattr(html_extract, "path_ratios", lambda page: dataclasses.replace(ratios(page), weight=np.ones(len(page.texts))))
    assert sum(html_extract.main_text(p) == t for p, t in zip(pages, texts, strict=True)) < 0.1 * len(pages)


def test_deep_pages_take_time_in_proportion():
    began = time.perf_counter()
    assert html_extract.main_text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert html_extract.main_text("<p>" + "<span>x" * 50_000) == "x" * 50_000
    assert time.perf_counter() - began < 10


def test_awkward_pages(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "<p>a &lt; b", "x"), (None, "u", "no markup & text", "x"), (3, "u", "<script>var a = '<p>x</p>'</script>", "x"), (4, "u", "<p>" + "word " * 50_000, "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["text"][:20]) for r in got] == [(1, ""), (2, ""), (2, "a < b"), (None, "no markup & text"), (3, ""), (4, "word word word word ")]
    assert got[5]["n_chars"] == 50_000 * 5 - 1
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Secrets -------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets(spark, awkward, no_documents):
    rng = random.Random(5)
    alphabet = secrets.BASE62
    tokens = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(20)]
    texts = [f"é text {t} ends" for t in tokens] + [
        "secret: token: abcdefgh", "PASSWORD = 'x1y2z3w4' and api_key:short", "token==abc=", "AKIA" + "A1" * 8, "AKIAAKIA" + "0" * 11, "dead" * 6, "dead" * 5 + "bee", "Donaudampfschifffahrt1gesellschaft and internationalization2018and", "aaaaaaaaaa1aaaaaaaaaaaaaaaaaa", "password: " + "ab" * 4000, "tokens " * 300 + "token=abcdef " * 700,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    for i, text in enumerate(texts):
        assert found[i]["base_sha256"] == hashlib.sha256(plain_base(text).encode()).hexdigest(), text[:60]
    added = [i for i, r in found.items() if "random" in r["spans"]]
    assert len(set(added) & set(range(20))) >= 17 and all(i < 20 for i in added)
    assert found[added[0]]["spans"] == "random:7:47"
    assert secrets.scan(awkward).count() == 10 and secrets.scan(no_documents).count() == 0
    clean = secrets.redact(awkward)
    assert clean.columns == awkward.columns and clean.count() == 10
    long = clean.filter("doc_id = 4").first()
    assert "hunter2" not in long["text"] and long["text"].count("[SECRET]") == 3000 and long["n_chars"] == len(long["text"])
    assert sorted(r["text"] for r in clean.filter("doc_id = 5").collect()) == sorted(r["text"] for r in awkward.filter("doc_id = 5").collect())


def plain_battery(token):
    """The chi-squared, runs and serial-correlation probabilities, and that of text, by plain loops over the stretches."""
    pieces = (len(token) - 1) // secrets.STRETCH + 1
    random_, text_ = [], []
    for i in range(pieces):
        part = token[i * len(token) // pieces : (i + 1) * len(token) // pieces]
        upper = re.fullmatch("[0-9a-f]+|[0-9A-F]+", part) is not None
        body = part.lower() if upper else re.sub("=+$", "", part).translate(str.maketrans("-_=", "+//"))
        alphabet = secrets.HEX_DIGITS if upper else secrets.BASE32 if re.fullmatch("[A-Z2-7]+", body) else secrets.BASE64 if re.search("[+/]", body) else secrets.BASE62
        k, n, codes = len(alphabet), len(body), [alphabet.index(c) for c in body]
        squares = sum(v * v for v in Counter(body).values())
        tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
        chi = tail((math.cbrt((k / n * squares - n) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
        high = sum(2 * c >= k for c in codes)
        runs = 1 + sum((2 * a >= k) != (2 * b >= k) for a, b in itertools.pairwise(codes))
        mean = 1 + 2 * high * (n - high) / n
        p_runs = 2 * tail(abs(runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))) if 2 <= high <= n - 2 else 0.0
        middle = sum(codes) / n
        r = sum((a - middle) * (b - middle) for a, b in itertools.pairwise(codes)) / max(sum((c - middle) ** 2 for c in codes), 1e-9)
        random_.append(min(1.0, 3 * min(chi, p_runs, 2 * tail(abs(r + 1 / n) * math.sqrt(n)))))
        expected = n * (n - 1) / 2 * secrets.TEXT_COINCIDENCE
        text_.append(secrets.TEXT_A_TO_F ** len(re.sub("[0-9]", "", body)) if upper else tail((expected - (squares - n) / 2) / math.sqrt(expected)))
    return pieces * min(random_), pieces * min(text_)


def plain_rejected(values, rate):
    """Benjamini-Hochberg over the binned values: the lowest rejected bin."""
    bins = [min(int(-math.log10(min(max(v, 1e-300), 1.0)) * 20), 400) for v in values]
    least = 401
    for b in set(bins):
        if 10 ** (-b / 20) <= rate * sum(x >= b for x in bins) / len(bins):
            least = min(least, b)
    return bins, least


def test_added_spans_against_plain_loops(spark):
    """Random tokens of any length are found, text is not, and every decision is that of plain loops."""
    rng = random.Random(8)
    made = {}
    for alphabet in (secrets.BASE62, secrets.BASE64, secrets.HEX_DIGITS.upper()):
        for n, count in ((24, 12), (40, 20), (512, 8), (513, 8), (2000, 6), (50_000, 4)):
            for _ in range(count):
                made[len(made)] = "".join(rng.choice(alphabet) for _ in range(n))
    n_random = len(made)
    words = "internationalization of donaudampf schifffahrts gesellschaft and file name version release build test data".split()
    for _ in range(120):
        made[len(made)] = "-".join(rng.choice(words) for _ in range(rng.randrange(4, 60))) + str(rng.randrange(100))
    docs = spark.createDataFrame([(i, f"a {t} z") for i, t in made.items()], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in secrets.scan(docs.repartition(4)).collect()}
    tokens = {i: t for i, t in made.items() if re.search("[0-9]", t) and re.search("[A-Za-z]", t)}
    covered = {i for i, t in tokens.items() if any(2 * (m.end() - m.start()) >= len(t) for m in re.finditer("[0-9a-f]{24,}", t))}
    tokens = {i: t for i, t in tokens.items() if i not in covered}
    p_random, p_text = zip(*map(plain_battery, tokens.values()), strict=True)
    (odd, most), (bins, least) = plain_rejected(p_random, 0.01), plain_rejected(p_text, 0.001)
    want = {i for i, a, b in zip(tokens, odd, bins, strict=True) if a < most and b >= least}
    assert {i for i, x in found.items() if x} == want
    assert all(found[i] == [(2, 2 + len(made[i]))] for i in want)
    long = [i for i in range(n_random) if len(made[i]) >= 40]
    assert len(want & set(long)) >= 0.95 * len(long) and max(want) < n_random


# Decontamination -----------------------------------------------------------------------------------------------------


def test_masks_miss_no_two_substitutions_in_a_window():
    for wrong in combinations(range(decontaminate.WINDOW), 2):
        assert any(all(at + x not in wrong for x in mask) for mask in decontaminate.MASKS for at in range(decontaminate.WINDOW - mask[-1])), wrong


def test_leaks(spark, awkward, no_documents):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choices(words, k=30)) for _ in range(5)] + ["five short words are here", "", None, "plain words of some text here"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    swapped = items[1].split()
    swapped[4] = swapped[11] = swapped[19] = "other"
    docs = [(0, "lead " + items[0].upper() + ", tail"), (1, " ".join(swapped)), (2, " ".join(items[2].split()[5:20])), (3, " ".join(rng.choices(words, k=300))), (4, "there are FIVE short, words are here!"), (5, "five short other are here"), (6, " ".join(items[3].split()[:9]))]
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 2), (4, 5)}
    assert (found[1, 1]["n_matched"], found[0, 0]["doc_start"], found[2, 2]["item_start"]) == (27, 1, 5)
    assert {r["doc_id"] for r in decontaminate.find_leaks(awkward, benchmark).collect()} == {1, 5}
    kept = decontaminate.drop_leaks(awkward, benchmark)
    assert kept.columns == awkward.columns and kept.count() == 7
    assert decontaminate.find_leaks(no_documents, benchmark).count() == 0 and decontaminate.find_leaks(awkward, benchmark.limit(0)).count() == 0


# Packing -------------------------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(7)
    for _ in range(30):
        histogram = {rng.randrange(1, 40): rng.randrange(1, 9) for _ in range(8)}
        bounds = packing.optimal_boundaries(histogram, 3)
        cost = lambda b: sum(n * (min(x for x in b if x >= k) - k) for k, n in histogram.items())
        lengths = sorted(histogram)
        best = min(cost([*c, lengths[-1]]) for k in range(3) for c in combinations(lengths[:-1], k))
        assert cost(bounds) == best and len(bounds) <= 3
    assert packing.optimal_boundaries({}, 3) == []


def test_packing(spark, awkward, no_documents, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = packing.pack(docs, max_length=300, token_budget=1200).toPandas()
    words = {r["doc_id"]: len(re.findall(r"[^ \t-\r]+", r["text"])) for r in docs.collect()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == words
    full = got[got.n_tokens > 0]
    assert (full.n_tokens <= full.bucket_len).all() and not full.duplicated(["batch_id", "slot"]).any()
    sizes = full.groupby(["bucket_len", "batch_id"]).size()
    assert (sizes * sizes.index.get_level_values(0) <= 1200).all()
    for bucket, group in sizes.groupby(level=0):
        assert (group < 1200 // bucket).sum() <= 1  # one batch may be short
    odd = packing.pack(awkward)
    assert odd.filter("n_tokens = 0").count() == 3 and odd.filter("doc_id = 4").count() > 1
    assert packing.pack(no_documents).count() == 0


# SimHash -------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(rb"[^ \t-\r]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_components(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = queries.op7_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def test_every_pair_within_the_threshold_is_linked(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(6) for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    classes = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, rep long")
    got = [tuple(sorted((r["src"], r["dst"]))) for r in simhash.linked_fingerprints(classes).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a, b in combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 4}


def test_awkward_simhash(spark, awkward, no_documents):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == 10
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["component_id"])
    assert by_id[2] == by_id[3] == by_id[7] == {2} and by_id[1] == {1} and 1 in by_id[5]
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    # Rows 5 with the text of row 1 go; row 5 with another text is a document of its own.
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:7]) for r in kept.collect()) == [("1", "plain w"), ("2", ""), ("4", "many wo"), ("5", "another"), ("8", "12 34 !"), ("None", "no id h")]
    again = spark.createDataFrame([(5, "t"), (5, "t"), (9, "t"), (5, "u"), (5, "u")], "doc_id long, text string")
    assert sorted(simhash.keep_first(again).collect()) == [(5, "t"), (5, "u")]
    assert simhash.keep_first(no_documents).count() == 0


# Toxicity ------------------------------------------------------------------------------------------------------------


def test_exception_phrases_take_time_in_proportion():
    automaton = toxicity.Model({" trash ": 1.0, " idiot ": 2.0}).matcher()
    began = time.perf_counter()
    assert toxicity.features_of(toxicity.fold("trash can " * 100_000 + "idiot"), automaton)[1] == pytest.approx(math.log1p(2.0))
    assert time.perf_counter() - began < 10


def test_folding():
    assert toxicity.fold("\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d i\u0301diot") == " idiot idiot "
    assert toxicity.fold("You 1D10T!! \u0456di\u043et, ＩＤＩＯＴ") == " you idiot idiot idiot "
    assert toxicity.fold("in 2024, für") == " in 2024 fur " and toxicity.fold(None) == toxicity.fold("") == " "


def test_matching_against_a_plain_search():
    model = toxicity.Model({" idiot ": 3.0, " idio": 2.0, " trash ": 1.0})
    automaton = model.matcher()
    weigh = lambda text: math.expm1(toxicity.features_of(toxicity.fold(text), automaton)[1])
    assert weigh("an idiot and idiots") == pytest.approx(5.0)
    assert weigh("the trash can, and trash") == pytest.approx(1.0)
    assert weigh("nothing here") == 0


def test_toxicity(spark, awkward, no_documents):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op8_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r["score"] for r in found if r["toxic"]], [r["score"] for r in found if not r["toxic"]]
    area = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert area > 0.85
    labels = spark.createDataFrame([(1, 0), (5, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    assert toxicity.score(awkward, model).count() == 10 and toxicity.score(no_documents, model).count() == 0
    assert toxicity.filter_toxic(awkward, toxicity.Model()).count() == 10
    assert toxicity.train(no_documents, labels.limit(0)).weights == model.weights == {f" {w} ": 5.0 for w in toxicity.SEEDS}
    repeated = awkward.filter("doc_id = 1").withColumn("text", F.lit("you idiot, an idiot"))
    assert toxicity.filter_toxic(repeated.union(repeated), model).count() == 0 and toxicity.filter_toxic(no_documents, model).columns == awkward.columns


# Repeats -------------------------------------------------------------------------------------------------------------


def plain_removal(texts, least):
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append((bytes(c for c, g in zip(t, gone, strict=True) if not g), sum(gone), len(re.findall(b"\1+", gone))))
    return out


def test_prefix_intervals():
    words = sorted([b"aab", b"aac", b"ab", b"b", b"ba", b"ba"])
    common = [len(re.match(b"(.*).*\0\\1", a + b"\0" + b)[1]) for a, b in zip(words, words[1:], strict=False)]
    assert set(repeats.prefix_intervals(np.array(common))) == {(0, 1, 2), (0, 2, 1), (4, 5, 2), (3, 5, 1), (0, 5, 0)}


@pytest.mark.parametrize("group", [2048, 7, 1])
def test_repeats(spark, awkward, no_documents, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # so that anchors meet in bands of windows
    rng = random.Random(9)
    noise = lambda n: rng.randbytes(n).hex()[:n]
    common, exact, near = noise(700), noise(900), noise(2000)
    texts = [noise(150 + 7 * i) + common[i % 50 : 700 - i % 90] + noise(130) for i in range(40)] + [exact] * 3 + [common[:399], common[:400], "", "é" * 450, "word " * 300, noise(5000)]
    texts += [near[: 100 * i] + noise(9) + near[100 * i :] for i in range(1, 18)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.deduplicate(docs).collect()}
    for i, (kept, removed, runs) in enumerate(plain_removal([t.encode() for t in texts], 400)):
        assert (bytes(got[i]["kept"]), sum(s["end"] - s["start"] for s in got[i]["spans"]), len(got[i]["spans"])) == (kept, removed, runs), i
    odd = repeats.deduplicate(awkward).collect()
    assert len(odd) == 10 and repeats.deduplicate(no_documents).count() == 0
    long = next(r for r in odd if r["doc_id"] == 4)
    assert len(long["kept"]) == 0 and long["n_bytes"] > 150_000


def test_repeats_of_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(docs, plain_removal(list(docs.values()), 400), strict=True))
    got = {r["doc_id"]: r for r in queries.op9_suffix_intervals(spark, sf_dir).collect()}
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == {i: (len(docs[i]), gone, runs, hashlib.sha256(kept).hexdigest()) for i, (kept, gone, runs) in want.items()}


def test_a_row_repeated_very_often(spark):
    docs = spark.createDataFrame([(1, "many words in one text, " * 30)], "doc_id long, text string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000))))
    spans = repeats.covered(docs, 400, "doc_id", "text").collect()
    assert len(spans) == 1 and len(spans[0]["spans"]) < 30


def test_anchors_across_chunks(monkeypatch):
    rng = random.Random(1)
    data = rng.randbytes(6000)
    whole = repeats.anchors(data, 400)
    monkeypatch.setattr(repeats, "_CHUNK_LOG", 11)
    parts = repeats.anchors(data, 400)
    for a, b in zip(whole, parts, strict=True):
        assert (a == b).all()
    place = whole[0]
    assert np.diff(place).max() <= 400 - repeats.GRAM + 1


def test_entry_has_all_operators(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert F is not None
