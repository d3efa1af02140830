"""The registered queries on a small folder of tables with nulls, repeats and clashing columns, held against plain Python."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urljoin

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from accordant.llm import importance, packing, quality, shared, toxicity, urls
from accordant.llm.kneser_ney import WordHashes
from accordant.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, row string, t1 string, _q_words string, gone string, _best string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(31)
    say = lambda n: " ".join(f"w{'abcdefgh'[rng.integers(8)]}{rng.integers(60)}" for _ in range(n))
    out = [(i, say(int(rng.integers(1, 90))) + (".\n" + say(5) if i % 3 else "")) for i in range(60)]
    out += [(100 + i, out[i][1]) for i in range(5)] + [(120 + i, out[i][1] + " Tail") for i in range(5)]
    return out + [(200, None), (201, ""), (201, "same id, other text here"), (None, "no id at all"), (None, None), (202, "É \x1c ünï 😀"), (203, "a b c d e a b c d e"), (204, say(3000)), (204, out[0][1]), (5, out[5][1])]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, x, "r", "t", "w", "g", "b") for i, x in rows], SCHEMA).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, i % 4 != 0, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality boolean, toxic int").withColumn("quality", F.col("quality").cast("int")).write.parquet(f"{place}/labels.parquet")
    bench = [(1, " ".join(words(rows[7][1])[:12])), (2, None), (10, "No id At"), (3, rows[7][1])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


@pytest.fixture(scope="module")
def got(spark, folder):
    return {name.split("_")[0]: [r.asDict() for r in QUERIES[name](spark, folder).collect()] for name in QUERIES if name not in ("op5_url_filter", "op3_pii", "op6_line_dedup")}


def by_id(found, *columns):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in columns)) for r in found)


def test_op1(rows, got):
    def fingerprint(text):
        w = words(low(text))
        parts = [" ".join(w)] if 0 < len(w) < 4 else [" ".join(w[k : k + 4]) for k in range(len(w) - 3)]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(i, fingerprint(x)) for i, x in rows]
    root = {x: x for _, x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for i, x in prints:
        if i is not None:
            least[find(x)] = min(least[find(x)], i)
    expected = sorted((-1 if i is None else i, f"{x:016x}", least[find(x)]) for i, x in prints)
    assert [(a, b, math.inf if c is None else c) for a, b, c in by_id(got["op1"], "fingerprint", "component_id")] == expected


def test_op4(rows, got):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in [(1, " ".join(words(rows[7][1])[:12])), (10, "No id At"), (3, rows[7][1])]:
        w = pattern.findall(low(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    expected = []
    for i, text in rows:
        w = pattern.findall(low(text))
        met = [(k, n, windows[tuple(w[k : k + n])]) for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows]
        ids = sorted({x for _, _, o in met for x in o})
        hit = len({j for k, n, _ in met for j in range(k, k + n)})
        expected.append((-1 if i is None else i, len(w), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert by_id(got["op4"], "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(expected)


def test_op8(rows, got):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda x: [*words(low(x)), "\n"]
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    total = sum(counts.values())
    expected = []
    for i, x in rows:
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (len(counts) + 1))) for t in tokens(x))
        expected.append((-1 if i is None else i, held(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total, round(base, 4)))
    found = [(*r[:5], round(r[5], 4)) for r in by_id(got["op8"], "held_out", "n_tokens", "n_known", "train_tokens", "base_score")]
    assert sorted(found) == sorted(expected)
    held_scores = [(r["score"], r["base_score"]) for r in got["op8"] if not r["held_out"]]
    assert all(s < 0 for s, _ in held_scores) and sum(s for s, _ in held_scores) > sum(b for _, b in held_scores)


def test_op9(rows, got):
    def expected(text):
        w = words(text)
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)

    assert by_id(got["op9"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted((-1 if i is None else i, *expected(x)) for i, x in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got["op9"])


def test_op10(rows, got):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    expected = []
    for i, x in rows:
        ids = np.array([*plain.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        expected += [(-1 if i is None else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert by_id(got["op10"], "piece", "start", "length", "ids_crc32") == sorted(expected)
    bins = defaultdict(list)
    for r in got["op10"]:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_encoder_on_random_strings():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    plain, encode = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder(packing.tokenizer_path())
    marks = list("ab Zé\n\t\r'12.,!-😀  ßçñ") + ["  ", "'s", "'LL", " the", "<|", "|>", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(marks, int(rng.integers(0, 30))))
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_op2(spark, rows, got, folder):
    hashes, known = WordHashes(), {i for i in range(60) if i % 4 != 0}
    found = [np.bincount(importance.buckets_of((x or "").encode(), hashes), minlength=importance.BUCKETS) for _, x in rows]
    raw, target = sum(found), sum(f for (i, _), f in zip(rows, found) if i in known)
    model = lambda n: np.log((n + 1) / (n.sum() + importance.BUCKETS))
    weight = [float(f @ (model(target) - model(raw))) for f in found]
    ids = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    noise = {r["doc_id"]: r["g"] for r in ids.select("doc_id", importance.gumbel().alias("g")).collect()}
    keyed = sorted(((w + noise[i], i, w) for (i, _), w in zip(rows, weight)), key=lambda x: (-x[0], math.inf if x[1] is None else x[1]))
    k = math.ceil(len(rows) * len(known) / 60)
    assert by_id(got["op2"]) == sorted((-1 if i is None else i,) for _, i, _ in keyed[:k])
    assert np.allclose(sorted(r["log_weight"] for r in got["op2"]), sorted(w for _, _, w in keyed[:k]), atol=1e-8)
    assert np.allclose(np.mean(list(noise.values())), 0.5772, atol=0.6)


def test_plain_em(rows):
    """EM over vote patterns equals EM over documents, whose classes are told by the same rules."""
    rng = np.random.default_rng(6)
    rules = ["a", "b", "c"]
    votes = [tuple(int(x) for x in rng.choice([-1, 0, 1], 3, p=p)) for p in [(0.1, 0.3, 0.6)] * 80 + [(0.7, 0.2, 0.1)] * 20]
    model = quality.fit(list(Counter(votes).items()), rules, 25)
    good = [0.1 if -1 in v else 0.9 for v in votes]
    for _ in range(25):
        prior = min(max((sum(good) + 1) / (len(votes) + 2), 0.01), 0.99)
        table = []
        for k in range(3):
            share = {}
            for vote in (-1, 0, 1):
                share[vote] = tuple((1 + sum(w for v, w in zip(votes, ws) if v[k] == vote)) / (3 + sum(ws)) for ws in ([1 - g for g in good], good))
            share[-1] = (max(share[-1]), share[-1][1])
            share[1] = (share[1][0], max(share[1]))
            share[0] = (1.0, 1.0)
            table.append(share)
        odds = [prior / (1 - prior) * math.prod(table[k][v[k]][1] / table[k][v[k]][0] for k in range(3)) for v in votes]
        good = [x / (1 + x) for x in odds]
    assert model.prior == pytest.approx(prior)
    for k, rule in enumerate(rules):
        for vote in (-1, 0, 1):
            assert model.table[rule][vote] == pytest.approx(table[k][vote])


def test_posteriors(spark):
    model = quality.VoteModel(0.7, {"a": {-1: (0.5, 0.1), 0: (1.0, 1.0), 1: (0.2, 0.6)}, "b": {-1: (0.4, 0.2), 0: (1.0, 1.0), 1: (0.3, 0.5)}})
    rows = list(itertools.product((-1, 0, 1), repeat=2))
    found = spark.createDataFrame(rows, "a int, b int").select("a", "b", model.posterior({"a": F.col("a"), "b": F.col("b")}).alias("p")).collect()
    for r in found:
        good, bad = (p * model.table["a"][r["a"]][i] * model.table["b"][r["b"]][i] for p, i in ((0.7, 1), (0.3, 0)))
        assert r["p"] == pytest.approx(good / (good + bad))


def test_noisy_or_against_plain_sums(spark):
    weights, bias = {"vile": 5.0, "vil-": 1.0, "bad": 3.0}, -4.0
    texts = ["Vile words. bad bad thing! fine", "fine", "", None, "vilest; Bad?vile", "VILE vile."]

    def plain(text):
        none = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            if found := set(re.findall(r"[a-z]+", sentence.lower())):
                z = bias + sum(sum(weights.get(f, 0) for f in toxicity.features(w.encode())) for w in found)
                none *= 1 - 1 / (1 + math.exp(-z))
        return 1 - none

    weights = weights | {"vile-": 0.0}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, bias, weights).collect()}
    assert got == pytest.approx({i: plain(x) for i, x in enumerate(texts)})


def test_slope_of_the_noisy_or():
    rng = np.random.default_rng(7)
    bags = toxicity.Bags(rng.integers(0, 2, 30), rng.integers(0, 4, 30), np.sort(rng.integers(0, 30, 50)), np.repeat(np.arange(50), 2), rng.integers(0, 6, 100))
    bags.plain[np.setdiff1d(np.arange(30), bags.doc)] += 1
    weights, bias = rng.normal(size=6), -1.5
    _, slope = toxicity.loss_and_slope(bags, bias, weights)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        up, down = (toxicity.loss_and_slope(bags, bias + s * step[6], weights + s * step[:6])[0] for s in (1, -1))
        assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_op7(rows, got):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    assert by_id(got["op7"], "held_out") == sorted((-1 if i is None else i, held(i)) for i, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got["op7"])


class TestUrls:
    def plain(self, pages, redirects=()):
        """(page, host, path, rule, verdict) by a union of all links."""

        def parts(url):
            rest = url.split("://", 1)[1] if url and "://" in url else ""
            return low(re.match(r"[^/?#]*", rest)[0]), re.match(r"[^/?#]*([^?#]*)", rest)[1]

        def node(url):
            host, path = parts(url)
            query = re.match(r"[^?#]*(\?[^#]*)?", url.split("://", 1)[1] if url and "://" in url else "")[1] or ""
            return (host, path or "/", query) if host else None

        def rule(host, path):
            fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            return max(fits)[2:] if fits else (None, None)

        links = [(node(a), node(b)) for a, b in redirects]
        for _, url, html in pages:
            for tag in re.findall(r"(?is)<link\b[^>]*>|<meta\b[^>]*>", html or ""):
                canonical = re.search(r"(?i)\brel\s*=\s*[\"']?canonical\b", tag) and re.search(r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", tag)
                refresh = re.search(r"(?i)http-equiv\s*=\s*[\"']?refresh\b", tag) and re.search(r"(?i);\s*url\s*=\s*[\"']?([^\"'>\s]+)", tag)
                for m in (x for x in (canonical, refresh) if x):
                    to = next(g for g in m.groups() if g is not None).strip()
                    if to and node(url):
                        links.append((node(url), node(urljoin(url.replace("ftp:", "http:"), to))))
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            if a and b:
                root[find(a)] = find(b)
        spread = defaultdict(set)
        for x in list(root):
            spread[find(x)].add(rule(x[0], x[1])[1])
        out = []
        for page, url, _ in pages:
            host, path = parts(url)
            name, verdict = rule(host, path)
            if not verdict:
                found = spread[find(node(url))] if node(url) in root else set()
                verdict = "allow" if "allow" in found or "block" not in found else "block"
            out.append((-1 if page is None else page, host, path, name, verdict))
        return sorted(out, key=str)

    def test_against_plain_links(self, spark, tmp_path):
        rng = np.random.default_rng(8)
        hosts = ["a.com", "B.com", "example.com", "x.example.net", "d.net", "e.org", "f.io"]
        paths = ["/", "", "/en/1", "/en/7x", "/de/2", "/de/8", "/es/3", "/p/q/r", "/p?x=1", "/p#f"]
        url = lambda: f"http://{rng.choice(hosts)}{rng.choice(paths)}"
        tags = ['<link rel="canonical" href="{}">', "<LINK href={} rel=canonical>", "<meta http-equiv='refresh' content='3; url={}'>", "<p>canonical {}</p>"]
        to = lambda: rng.choice([url(), "/es/4", "../es/5", "z", "./y", "//d.net/de/1", "?q=2", "#t", "", "a/../../en/9", ".."])
        pages = [(i, url(), "".join(rng.choice(tags).format(to()) for _ in range(rng.integers(0, 3))) if i % 3 else None) for i in range(120)]
        pages += [(200, None, "<link rel=canonical href=/x>"), (201, "nourl", "x"), (None, "http://a.com/en/1", ""), (3, pages[3][1], pages[3][2])]
        spark.createDataFrame([(*p, "n", "b") for p in pages], "page_id long, url string, html string, node string, _best string").write.parquet(str(tmp_path / "pages.parquet"))
        got = [tuple(r) for r in QUERIES["op5_url_filter"](spark, str(tmp_path)).select(F.coalesce("page_id", F.lit(-1)), "host", "path", "rule", "verdict").collect()]
        expected = self.plain(pages)
        assert sorted(got, key=str) == expected
        assert len({v for *_, r, v in expected if r is None}) == 2


def test_stages_stand_odd_tables(spark, folder):
    """Each stage on nulls, repeats and clashing names, and on no rows; quality's result aside, each on that of the one before."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for empty in (False, True):
        held = docs.limit(0) if empty else docs
        scratch = shared.Scratch(spark, "odd")
        assert corpus_pipeline.STAGES[0][1](spark, held, folder).columns == docs.columns
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            held = scratch.keep(stage(spark, held, folder), name)
            assert held.columns == docs.columns
        found = {(r["doc_id"], r["text"]) for r in held.collect()}
        # one of those that are empty or whose lines all repeat, and 7, which is an item of the benchmark
        without = sorted(i for i, x in found if i is not None and not x)
        assert (without, found) == ([], set()) if empty else without == [7, 100] and {(201, "same id, other text here"), (None, None)} <= found
        packed = corpus_pipeline.STAGES[-1][1](spark, held, folder)
        assert (packed.count() == 0) is empty
