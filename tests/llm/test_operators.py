"""Each corpus operator against a plain brute-force version on small tables with nulls, empty texts, ties and clashing columns."""

import dataclasses
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from accordant.llm import decontaminate, importance, kneser_ney, linededup, packing, pii, quality, shared, simhash, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, component_id string, n_words int, line string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def documents(spark, rows):
    """With columns whose names the operators use too."""
    return spark.createDataFrame([(i, x, "en", "c", 1, "l") for i, x in rows], SCHEMA)


def invented(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        text = invented(rng, int(rng.integers(1, 120)))
        rows.append((3 * i, text))
        if i % 4 == 0:
            rows.append((3 * i + 1, text))
        if i % 5 == 0:
            rows.append((3 * i + 2, text.replace("w1 ", "w2 ", 1) + " Tail"))
    long = invented(rng, 3000)
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (None, "no id"), (905, "É é x ünï"), (906, long), (906, long), (907, long + " more")]


class TestComponents:
    def run(self, spark, edges):
        found = shared.connected_components(spark.createDataFrame(edges, "u long, v long"))
        return {r["node"]: r["component"] for r in found.collect()}

    def test_paths_stars_and_loops(self, spark):
        path = [(i, i + 1) for i in range(20)]
        star = [(100, i) for i in range(101, 120)] + [(115, 99)]
        zigzag = [(200, 300), (300, 201), (201, 301), (301, 202)]
        got = self.run(spark, path + star + zigzag + [(7, 7), (500, 500)])
        expected = {i: 0 for i in range(21)} | {i: 99 for i in range(99, 120)} | {i: 200 for i in (200, 201, 202, 300, 301)}
        assert got == expected

    def test_no_edges(self, spark):
        assert self.run(spark, []) == {} and self.run(spark, [(1, 1), (None, 2)]) == {}


class TestSimHash:
    def test_triples_meet_every_four_positions(self):
        triples = simhash.covering_triples()
        assert len(triples) == 20
        assert all(any(set(t) <= set(four) for t in triples) for four in itertools.combinations(range(8), 4))

    def fingerprint(self, text):
        w = words(low(text))
        parts = [" ".join(w)] if 0 < len(w) < 4 else [" ".join(w[k : k + 4]) for k in range(len(w) - 3)]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    def components(self, prints):
        ids = sorted(prints)
        root = {i: i for i in ids}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in itertools.combinations(ids, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        return {i: find(i) for i in ids}

    def test_against_all_pairs(self, spark, corpus):
        got = simhash.near_duplicates(documents(spark, corpus)).collect()
        assert len(got) == len(corpus)
        prints = {i: self.fingerprint(x) for i, x in corpus if i is not None}
        expected = self.components(prints)
        for r in got:
            if r["doc_id"] is not None:
                assert r["fp"] % 2**64 == prints[r["doc_id"]] and r["component_id"] == expected[r["doc_id"]]

    @pytest.mark.parametrize("block", [4096, 7])
    def test_dense_groups(self, spark, monkeypatch, block):
        """Fingerprints of few bits, so postings are long; with small blocks they are cut into pairs of blocks."""
        monkeypatch.setattr(simhash, "BLOCK", block)
        rng = np.random.default_rng(2)
        base = [int(x) for x in rng.integers(0, 2**62, 6)]
        prints = {}
        for i in range(150):
            x = base[i % 6]
            for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                x ^= 1 << int(b)
            prints[i] = x
        nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for x, i in {x: i for i, x in sorted(prints.items(), reverse=True)}.items()], "fp0 long, rep long")
        links = simhash.near_links(nodes, shared.Scratch(spark, "test"))
        found = {r["node"]: r["component"] for r in shared.connected_components(links).collect()}
        expected = self.components(prints)
        assert all(found.get(i, i) == c for i, c in expected.items() if min(k for k, x in prints.items() if x == prints[i]) == i)

    def test_keep_first(self, spark):
        rows = [(5, "a b c d e"), (3, "A b c d e"), (9, "quite another text here"), (9, "quite another text here"), (None, "x")]
        kept = simhash.keep_first(documents(spark, rows))
        assert kept.columns == documents(spark, rows).columns
        assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 9]

    def test_texts_under_one_id_stay(self, spark):
        rows = [(9, "one text about something else"), (9, "and a wholly different one"), (10, "and a wholly different one"), (11, None), (12, ""), (None, None)]
        docs = documents(spark, rows).withColumnsRenamed({"lang": "t1", "line": "row", "n_words": "component", "component_id": "place"})
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())) == [(0, ""), (9, "and a wholly different one"), (9, "one text about something else"), (11, "")]
        assert simhash.keep_first(documents(spark, [])).collect() == []

    def test_spread_triples(self):
        found = simhash.SIMILAR.triples
        assert len(set(found)) == len(found) == 320
        used = Counter(p for t in found for p in t)
        assert set(used) == set(range(32)) and max(used.values()) < 2 * min(used.values())

    @pytest.mark.parametrize("block", [4096, 7])
    def test_similar_groups_against_all_pairs(self, spark, monkeypatch, block):
        monkeypatch.setattr(simhash, "BLOCK", block)
        rng = np.random.default_rng(21)
        rows = []
        for g in range(25):
            base = invented(rng, int(rng.integers(60, 400)), 5000).split()
            rows.append((len(rows), " ".join(base)))
            for _ in range(int(rng.integers(0, 6))):
                w = list(base)
                for _ in range(int(rng.integers(0, 1 + len(w) // 25))):
                    w[rng.integers(len(w))] = "Zz%d" % rng.integers(9)
                rows.append((len(rows), " ".join(w)))
        sets = {i: {tuple(low(x).split()[k : k + 5]) for k in range(len(x.split()) - 4)} for i, x in rows}
        pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
        got = defaultdict(set)
        for r in simhash.similar_groups(documents(spark, rows), shared.Scratch(spark, "test")).collect():
            got[r["component"]].add(r["doc_id"])
        of = {i: c for c, ids in got.items() for i in ids}
        alike = [p for p, x in pairs.items() if x >= 0.8]
        met = [p for p in alike if of[p[0]] == of[p[1]]]
        assert len(alike) > 40 and len(met) >= 0.95 * len(alike)
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in alike:
            root[find(a)] = find(b)
        assert all(len({find(i) for i in ids}) == 1 for ids in got.values())  # no group beyond what similar texts join

    def test_empty_table(self, spark):
        assert simhash.near_duplicates(documents(spark, [])).collect() == []


class TestQuality:
    def expected(self, text):
        w = words(text)
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)

    def test_counts(self, spark, corpus):
        rows = corpus + [(950, "a b c d e a b c d e a b"), (951, "x\nx\n \n\t\nx y"), (952, "## $ a|b " * 9), (953, "a a a a a a"), (954, "a b c d e f\nq\na b c d e f")]
        got = quality.judged(documents(spark, rows)).collect()
        show = lambda r: tuple(r[f"_q_{c}"] for c in quality.COUNTS) + (r["_q_base_failed"],)
        assert sorted((r["doc_id"] or -1, show(r)) for r in got) == sorted((i or -1, self.expected(x)) for i, x in rows)

    def test_votes_find_junk(self, spark):
        rng = np.random.default_rng(3)
        text = lambda: ". ".join(invented(rng, 12).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")).capitalize() for _ in range(6)) + "."
        good = [(i, text()) for i in range(120)]
        junk = [(200 + i, " ".join(f"{w}{'#$%'[i % 3] * 3}" for w in text().split())) for i in range(12)] + [(300 + i, text().upper().replace(" ", "!! ")) for i in range(12)]
        kept = {r["doc_id"] for r in quality.quality_filter(documents(spark, good + junk)).collect()}
        assert kept == {i for i, _ in good}

    def test_filter_keeps_columns_and_stands_empty_tables(self, spark):
        empty = documents(spark, [])
        assert quality.quality_filter(empty).columns == empty.columns and quality.quality_filter(empty).count() == 0


class TestPii:
    PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def base(self, text):
        out = []
        for kind, pattern in self.PATTERNS:
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                doubled = [int(d) if k % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for k, d in enumerate(reversed(digits))]
                fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15}
                if fits[kind]:
                    out.append((kind, m.start(), m.end()))
        return out

    def test_base_spans(self, spark):
        texts = [
            None, "", "a@b.c_x@d.e a.b@c.d.e, x@y z@@q.r 1.2.3.4.5.6.7.8 001.2.3.0255 256.1.1.1", "é😀 me@x.org 😀 4111 1111 1111 1111 and +1 (555) 010-9999-- +12 x",
            "9" * 600 + " " + "a." * 200 + "@" + "b." * 200 + "c", " ".join(f"1.2.3.{k % 256}" for k in range(700)), "+1" + " " * 500 + "x +1 2 3 4 5 6 7 8", "a@b..c a@-b.c %@x.y", "x" * 2000, "4111-1111-1111-1111 4111111111111112",
        ]
        got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in pii.with_base(documents(spark, list(enumerate(texts)))).collect()}
        assert got == {i: self.base(x) for i, x in enumerate(texts)}

    def test_very_long_runs(self, spark):
        texts = ["9" * 60000 + " " + "a." * 30000 + "@" + "b." * 30000 + "c", "x" * 300000, "+1" + " " * 60000 + "x"]
        got = pii.with_base(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
        assert [len(r["base"]) for r in got] == [1, 0, 0]

    def test_terms_that_disclose(self, spark):
        rows = [(i, f"{'abcd'[i] * 4} ask Zorblatt at z@corp.com please\nthe plain line {i}") for i in range(4)] + [(60 + i, "copied Quonk q@corp.com\n") for i in range(4)] + [(10 + i, "please ask the plain others") for i in range(30)]
        found = {r["doc_id"]: r for r in pii.pii_spans(documents(spark, rows)).collect()}
        assert set(found) == {0, 1, 2, 3, 60, 61, 62, 63} and [s["kind"] for s in found[60]["spans"]] == ["email"]
        kinds = [(s["kind"], s["value"]) for s in found[0]["spans"]]
        assert kinds == [("email", "z@corp.com"), ("term", "Zorblatt")]
        clean = pii.pii_spans(documents(spark, rows)).select("doc_id", pii.sanitised(F.col("text"), F.col("spans"))).where("doc_id = 0").first()[1]
        assert clean == "aaaa ask [term] at [email] please\nthe plain line 0"

    def test_terms_of_rare_entities(self, spark):
        rows = [(0, "ask Zorblatt at z@corp.com please")] + [(10 + i, "please ask the plain others") for i in range(200)]
        rows += [(300 + i, f"{'abcdefgh'[i] * 4} Quizzle 1.2.3.4") for i in range(8)] + [(400, "a quizzle elsewhere")]
        found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in pii.pii_spans(documents(spark, rows)).collect()}
        assert found[0] == [("email", "z@corp.com"), ("term", "Zorblatt")]
        assert found[400] == [("term", "quizzle")] and not any(10 <= i < 300 for i in found)

    def expected_terms(self, rows):
        """Spans of kind term by a plain count of all words and entities of all rows."""
        word = re.compile(r"[A-Za-z\x80-\U0010FFFF]+")
        near = defaultdict(set)
        for k, (_, text) in enumerate(rows):
            for kind, a, b in self.base(text):
                value = text[a:b]
                entity = low(value) if kind == "email" else value if kind == "ip" else re.sub(r"[ ().-]", "", value)
                pattern = re.compile(dict(self.PATTERNS)[kind])
                ends = [m.end() for m in pattern.finditer(text) if m.end() <= a] or [0]
                starts = [m.start() for m in pattern.finditer(text) if m.start() >= b] or [len(text)]
                left, right = text[ends[-1] : a].split("\n")[-1], text[b : starts[0]].split("\n")[0]
                left = re.sub(r"^\S+", "", left[-pii.NEAR :]) if len(left) > pii.NEAR else left
                right = re.sub(r"\S+$", "", right[: pii.NEAR]) if len(right) > pii.NEAR else right
                near[k, entity] |= set(word.findall(re.sub(r"\S*[@0-9]\S*", " ", left + " " + right).lower()))
        n_term = Counter(w for _, text in rows for w in set(word.findall((text or "").lower())))
        n_entity = Counter(e for _, e in near)
        n_both, lines = Counter(), defaultdict(set)
        for (_, e), terms in near.items():
            for t in terms:
                n_both[e, t] += 1
                lines[e, t].add(frozenset(terms))
        telling = set()
        for (e, t), n in n_both.items():
            if not n_term[t]:
                continue  # what is left of a word that an entity begins in
            share, known = n_entity[e] / len(rows), len(lines[e, t])
            of = (known * min(1, n / n_term[t]) + pii.PRIOR * share) / (known + pii.PRIOR)
            if len(t) >= 3 and share < 1 and math.log2(of / share) >= -pii.THRESHOLD * math.log2(share):
                telling.add(t)
        out = []
        for i, text in rows:
            base = self.base(text)
            spans = [("term", m.start(), m.end()) for m in word.finditer(text or "") if m[0].lower() in telling and not any(a < m.end() and m.start() < b for _, a, b in base)]
            out.append((i if i is not None else -1, base + spans))
        return sorted(out), telling

    def test_query_against_counts(self, spark, tmp_path):
        rng = np.random.default_rng(12)
        rows = [(i, invented(rng, 40, 90).translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(150)]
        names = ["Ábel", "berta", "Ceci", "dora"]
        for k in range(60):
            i, text = rows[k]
            w = text.split()
            w[5 : 5 + k % 3] = [names[k % 4], f"{names[k % 4].lower()}@x{k % 4}.org", "+1 555 0100-99" + str(k % 2)][: 1 + k % 3]
            rows[k] = (i, "\n".join([" ".join(w[:20]), " ".join(w[20:]) + (" 10.0.0.%d" % (k % 9))]) + (" long" * 60 if k % 7 == 0 else ""))
        rows += [rows[3], rows[3], (3, "another text of id three BERTA berta@x1.org"), (None, rows[4][1]), (None, None), (900, ""), (901, "ceci alone"), (902, "write Quxley at q9@zz.org today"), (903, "no QUXLEYS, one quxley"), (904, "mail Vandor q8@zz.org\nVandor"), (905, "mail vandor q8@zz.org")]
        documents(spark, rows).withColumnsRenamed({"lang": "base", "line": "terms", "n_words": "t1", "component_id": "row"}).write.parquet(str(tmp_path / "documents.parquet"))
        expected, telling = self.expected_terms(rows)
        got = pii.op3_pii(spark, str(tmp_path)).collect()
        show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        digest = lambda spans: hashlib.sha256(show([s for s in spans if s[0] != "term"]).encode()).hexdigest()
        count = lambda spans: tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        assert telling
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["spans"], r["base_sha256"], tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone"))) for r in got) == sorted((i, show(x), digest(x), count(x)) for i, x in expected)

    def test_terms_on_the_test_tables(self, spark):
        found = pii.op3_pii(spark, "/root/testdata/sf0.001").collect()
        assert len(found) == 200 and any("term:" in r["spans"] and r["base_sha256"] != hashlib.sha256(b"").hexdigest() for r in found)

    def test_rows_without_an_id_and_repeated_ones(self, spark, tmp_path):
        documents(spark, [(None, "x@y.zz"), (1, "a@b.cc"), (1, "a@b.cc d@e.ff"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
        got = pii.op3_pii(spark, str(tmp_path)).collect()
        assert sorted((r["doc_id"] or 0, r["n_email"]) for r in got) == [(0, 1), (1, 1), (1, 2), (2, 0)]

    def test_empty_table(self, spark):
        assert pii.pii_spans(documents(spark, [])).collect() == []


class TestDecontamination:
    def test_index(self):
        rng = np.random.default_rng(0)
        for top, size in ((1, 40), (4, 300), (30, 500)):
            text = rng.integers(1, top + 1, size)
            index = decontaminate.FMIndex(text, top)
            phrases = np.array(list(itertools.islice(itertools.product(range(1, top + 1), repeat=3), 400)))
            for p, a, b in zip(phrases, *index.search(phrases)):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(size - 2) if (text[i : i + 3] == p).all()]

    def test_suffix_array(self):
        text = np.append(np.random.default_rng(1).integers(1, 3, 200), 0)
        assert decontaminate.suffix_array(text).tolist() == sorted(range(201), key=lambda i: text[i:].tolist())

    @pytest.mark.parametrize(("chars", "shard"), [(64_000_000, 2_000_000), (300, 50)])
    def test_against_all_windows(self, spark, monkeypatch, chars, shard):
        monkeypatch.setattr(decontaminate, "PASS_CHARS", chars)
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        rng = np.random.default_rng(4)
        items = [(i, invented(rng, 30, 60)) for i in range(12)] + [(50, "Short one"), (51, "solo"), (52, None), (53, " .,"), (None, "w1"), (54, "Short one")]
        docs = []
        for i in range(60):
            w = invented(rng, 60, 60).split()
            if i % 3 == 0:
                w[20:35] = items[i % 12][1].upper().split()[5:20]
            docs.append((i, ", ".join(w) + ("\nSHORT-one é solo" if i % 7 == 0 else "")))
        docs += [(100, None), (101, ""), (102, items[0][1] + " " + items[0][1]), (102, items[0][1]), (None, "solo")] + [(110 + i, items[1][1]) for i in range(20)]
        pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        windows = defaultdict(set)
        for item, text in items:
            w = pattern.findall(low(text))
            n = min(10, len(w))
            for k in range(len(w) - n + 1 if n and item is not None else 0):
                windows[tuple(w[k : k + n])].add(str(item))
        expected = []
        for i, text in docs:
            w = pattern.findall(low(text))
            met = [(k, n, windows[tuple(w[k : k + n])]) for n in {len(x) for x in list(windows)} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows]
            hit = {j for k, n, _ in met for j in range(k, k + n)}
            ids = sorted({x for _, _, o in met for x in o})
            expected.append((i or -1, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = decontaminate.digest(decontaminate.contamination(documents(spark, docs), bench)).collect()
        assert sorted((r["doc_id"] or -1, *r[1:]) for r in got) == sorted(expected)

    def test_spans_are_cut(self, spark):
        bench = spark.createDataFrame([(1, "one two three"), (2, "three four five")], "item_id long, text string")
        docs = documents(spark, [(1, "Keep. ONE, two three\nfour (five) end"), (2, None), (3, "é one two")])
        out = decontaminate.decontaminated(docs, bench)
        assert out.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Keep. ) end", 2: None, 3: "é one two"}

    def test_empty_tables(self, spark):
        bench = spark.createDataFrame([], "item_id long, text string")
        assert decontaminate.contamination(documents(spark, []), bench).collect() == []
        assert decontaminate.digest(decontaminate.contamination(documents(spark, [(1, "a b")]), bench)).first()["contaminated"] is False


class TestUrls:
    def test_rules_and_aliases(self, spark):
        pages = [
            (1, "http://a.com/x", '<link rel="canonical" href="http://b.org/es/1">'), (2, "https://a.com/x#f", ""), (3, "http://c.com/", '<meta http-equiv="refresh" content="0; url=/y">'), (4, "http://c.com/y", "<link href=//d.net/de/1 rel=canonical>"),
            (5, "http://d.net/q?z", None), (6, None, None), (7, "nourl", ""), (8, "http://E.org/es/2", '<link rel="canonical" href="/de/3">'), (9, "http://e.org/de/3", ""), (10, "HTTP://www.Example.com/en/77", ""), (11, "http://com/en/", ""),
            (12, "http://xcom/en/", ""), (13, "http://a.example.net/de/8?q", ""), (13, "http://a.example.net/de/8?q", ""), (None, "ftp://q.net", ""), (14, "http://f.com/p", "<link rel=canonical href='http://g.org/es/'>"), (15, "http://f.com/p?r", '<LINK REL="canonical" HREF="http://f.com/p">'), (16, "http://f.com/ok", "<link rel=canonical href=http://h.net/de/>"), (17, "http://f.com/ok2", "<link rel=canonical href=http://f.com/ok>"),
        ]
        frame = spark.createDataFrame(pages, "page_id long, url string, html string")
        got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged_pages(frame, urls.rule_table(spark)).collect())
        assert got == [
            (0, "q.net", "", None, "allow"), (1, "a.com", "/x", None, "block"), (2, "a.com", "/x", None, "block"), (3, "c.com", "/", None, "allow"), (4, "c.com", "/y", None, "allow"), (5, "d.net", "/q", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
            (8, "e.org", "/es/2", "org/es/", "block"), (9, "e.org", "/de/3", None, "block"), (10, "www.example.com", "/en/77", "example.com/en/7", "allow"), (11, "com", "/en/", "com/en/", "block"), (12, "xcom", "/en/", None, "allow"),
            (13, "a.example.net", "/de/8", "example.net/de/8", "block"), (13, "a.example.net", "/de/8", "example.net/de/8", "block"), (14, "f.com", "/p", None, "block"), (15, "f.com", "/p", None, "block"), (16, "f.com", "/ok", None, "allow"), (17, "f.com", "/ok2", None, "allow"),
        ]

    def test_allow_comes_first_in_a_component(self, spark):
        pages = spark.createDataFrame([(1, "http://a.x/1", "")], "page_id long, url string, html string")
        moves = spark.createDataFrame([("http://a.x/1", "http://b.org/es/"), ("http://a.x/1", "http://c.net/de/")], "source_url string, target_url string")
        assert urls.judged_pages(pages, urls.rule_table(spark), moves.limit(1)).first()["verdict"] == "block"
        assert urls.judged_pages(pages, urls.rule_table(spark), moves).first()["verdict"] == "allow"

    def test_empty_table(self, spark):
        assert urls.judged_pages(spark.createDataFrame([], "page_id long, url string, html string"), urls.rule_table(spark)).collect() == []


class TestLines:
    @staticmethod
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def near(self, a, b, edits):
        k = max((k for n, k in edits if min(len(a), len(b)) >= n), default=0)
        return a != b and abs(len(a) - len(b)) <= k and self.distance(a, b) <= k

    def brute(self, docs, edits):
        """By (doc_id, text): links and removed lines."""
        where = defaultdict(set)
        for i, text in docs:
            for k, line in enumerate((text or "").split("\n")):
                line = line.strip(" \t\n\v\f\r")
                if i is not None and (len(line) >= edits[0][0] or re.search(r"\w", line)):
                    where[line].add((i, text or "", k))
        root = {x: x for x in where}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        links = Counter()
        for a, b in itertools.combinations(where, 2):
            if self.near(a, b, edits):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
        order = lambda at: (at[0], xxhash.xxh64_intdigest(at[1].encode(), 42) % linededup.TEXTS, at[2])
        heads = {}
        for x in where:
            heads[find(x)] = min([*where[x], *([heads[find(x)]] if find(x) in heads else [])], key=order)
        out = {}
        for x in where:
            for at in where[x]:
                found = out.setdefault(at[:2], [0, []])
                found[0] += links[x]
                if at != heads[find(x)]:
                    found[1].append((at[2], heads[find(x)][0], heads[find(x)][2]))
        return {i: (n, sorted(r)) for i, (n, r) in out.items() if n or r}

    def found(self, spark, docs, edits):
        by = {(i, xxhash.xxh64_intdigest((x or "").encode(), 42)): x or "" for i, x in docs}
        rows = linededup.repeated_lines(documents(spark, docs), True, edits).collect()
        return {(r["doc_id"], by[r["doc_id"], r["t1"] % 2**64]): (r["n_links"], [tuple(x) for x in r["removed"]]) for r in rows if r["n_links"] or r["removed"]}

    @pytest.mark.parametrize(("edits", "bucket"), [(((20, 1),), 200), (((20, 1),), 3), (((20, 2),), 200), (((20, 2),), 3), (((20, 1), (32, 2)), 3), (((20, 1), (31, 2), (34, 3)), 200)])
    def test_against_all_pairs(self, spark, monkeypatch, edits, bucket):
        monkeypatch.setattr(linededup, "BUCKET", bucket)
        rng = np.random.default_rng(6)
        base = [f"the quick brown fox jumps {'over ' * (i % 2)}it {i}" for i in range(5)]

        def change(x):
            k, c = int(rng.integers(len(x))), rng.choice(list("abcé😀"))
            return [x[:k] + c + x[k + 1 :], x[:k] + c + x[k:], x[:k] + x[k + 1 :]][rng.integers(3)]

        docs = []
        for i in range(50):
            lines = []
            for _ in range(rng.integers(6)):
                x = base[rng.integers(5)]
                for _ in range(rng.integers(4)):
                    x = change(x)
                lines.append(x)
            docs.append((i, "\n".join(lines)))
        docs += [(100, None), (101, ""), (102, "short\nshort\n--\n--"), (103, docs[3][1]), (103, docs[3][1]), (None, docs[4][1]), (104, "an entirely different line of one id\n" + base[0]), (104, base[0] + "\nand a line that is there once")]
        assert self.found(spark, docs, edits) == self.brute(docs, edits)

    def test_shifts_cover_all_edits(self):
        """Whatever k edits do, some segment of the shorter string stands at a probed place of the longer one."""
        rng = np.random.default_rng(13)
        for _ in range(3000):
            k, n = int(rng.integers(1, 4)), int(rng.integers(12, 30))
            a = "".join(rng.choice(list("ab"), n))
            b = a
            for _ in range(k):
                at = int(rng.integers(len(b)))
                b = [b[:at] + "c" + b[at + 1 :], b[:at] + "c" + b[at:], b[:at] + b[at + 1 :]][rng.integers(3)]
            s, r = sorted((a, b), key=len)
            cuts = [len(s) * i // (k + 1) for i in range(k + 2)]
            places = [(i, x) for i in range(k + 1) for x in linededup.probed_shifts(k, i, len(r) - len(s))]
            assert any(s[cuts[i] : cuts[i + 1]] == r[cuts[i] + x : cuts[i + 1] + x] and cuts[i] + x >= 0 for i, x in places)

    def test_texts_under_one_id_keep_their_lines(self, spark):
        rows = [(2, "some other first line kept here\nsecond"), (2, "the same long line that repeats\nthird"), (3, "the same long line that repeats\nmore")]
        docs = documents(spark, rows).withColumnsRenamed({"lang": "gone", "line": "t1", "n_words": "removed", "component_id": "row"})
        out = linededup.without_repeats(docs)
        assert out.columns == docs.columns
        assert sorted(r["text"] for r in out.collect()) == ["more", "some other first line kept here\nsecond", "the same long line that repeats\nthird"]

    def test_texts_lose_repeats(self, spark):
        line = "a line that is long enough"
        docs = documents(spark, [(1, f"{line}\nend"), (2, f"start\n{line}!\nend"), (3, None), (4, ""), (None, line)])
        out = linededup.without_repeats(docs)
        assert out.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"{line}\nend", 2: "start\nend", 3: None, 4: "", None: line}

    def test_short_lines(self, spark, tmp_path):
        documents(spark, [(1, "Les.\n--\nends in nineteen c"), (2, " Les. \nLex.\n--\nends in nineteen d"), (3, "")]).write.parquet(str(tmp_path / "documents.parquet"))
        got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in linededup.op6_line_dedup(spark, str(tmp_path)).collect()}
        assert got == {1: [], 2: [(0, 1, 0)], 3: []}

    def test_empty_table(self, spark):
        assert linededup.repeated_lines(documents(spark, [])).collect() == []


class TestKneserNey:
    @pytest.mark.parametrize(("order", "sizes"), [(2, (12_000_000, 400_000, 1_500_000)), (2, (2_000, 300, 400)), (3, (12_000_000, 400_000, 1_500_000)), (3, (2_000, 300, 400)), (4, (2_000, 300, 400))])
    def test_against_counts(self, spark, monkeypatch, corpus, order, sizes):
        for name, x in zip(("RANGE_CHARS", "BLOCK_TOKENS", "HELD_PAIRS"), sizes):
            monkeypatch.setattr(kneser_ney, name, x)
        rows = corpus + [(950, "w1 w2 UNSEEN")]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        crc = F.pmod(shared.crc32_of(F.col("doc_id")), F.lit(3)) == 0
        got = kneser_ney.perplexities(documents(spark, rows), crc & F.col("doc_id").isNotNull(), order).collect()
        token = lambda x: [*(x or "").encode().lower().split(), b"</s>"]
        padded = lambda x: [b"<s>"] * (order - 1) + token(x)
        grams = lambda x: [tuple(t[k : k + order]) for t in [padded(x)] for k in range(len(t) - order + 1)]
        raw, levels = Counter(), {order: Counter()}
        for i, x in rows:
            if not held(i):
                raw.update(token(x))
                levels[order].update(grams(x))
        for m in range(order - 1, 0, -1):
            levels[m] = Counter(g[1:] for g in levels[m + 1])
        d = {m: kneser_ney.discounts([sum(n == k for n in counts.values()) for k in range(1, 5)]) for m, counts in levels.items()}
        follow, kinds = Counter(), defaultdict(Counter)
        for m in range(2, order + 1):
            for g, n in levels[m].items():
                follow[g[:-1]] += n
                kinds[g[:-1]][min(n, 3)] += 1
        total = sum(levels[1].values())
        rest = sum(d[1][min(n, 3)] for n in levels[1].values()) / total / (len(raw) + 1)

        def p(g):
            if len(g) == 1:
                return (levels[1][g] - d[1][min(levels[1][g], 3)]) / total + rest
            if not follow[g[:-1]]:
                return p(g[1:])
            n, m = levels[len(g)][g], len(g)
            return (n - d[m][min(n, 3)]) / follow[g[:-1]] + sum(d[m][k] * c for k, c in kinds[g[:-1]].items()) / follow[g[:-1]] * p(g[1:])

        behind = (b"<s>",) * (order - 2) + (b"w1",)
        assert sum(p((*behind, w)) for w in raw) + p((*behind, b"?")) == pytest.approx(1)
        total_raw = sum(raw.values())
        expected = []
        for i, x in rows:
            t = token(x)
            base = sum(math.log10((raw[w] + 0.1) / (total_raw + 0.1 * (len(raw) + 1))) for w in t)
            expected.append((i or -1, held(i), len(t), sum(raw[w] > 0 for w in t), total_raw, round(base, 6), round(sum(math.log10(p(g)) for g in grams(x)), 6)))
        found = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
        assert [x[:5] for x in found] == [x[:5] for x in sorted(expected)]
        assert np.allclose([x[5:] for x in found], [x[5:] for x in sorted(expected)], atol=1e-5)

    def test_nothing_to_learn_from(self, spark):
        got = kneser_ney.perplexities(documents(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
        assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
        assert kneser_ney.perplexities(documents(spark, []), F.lit(False)).collect() == []

    def test_packing_columns(self):
        rng = np.random.default_rng(0)
        columns = [np.sort(rng.integers(0, 2**63, 100).astype(np.uint64)), rng.integers(0, 2**63, 7).astype(np.uint64), rng.integers(0, 9, 0).astype(np.uint32)]
        assert all(a.tolist() == b.tolist() for a, b in zip(columns, kneser_ney.unpacked(kneser_ney.packed(columns)), strict=True))

    def test_counts_beyond_a_byte(self, spark):
        got = kneser_ney.perplexities(documents(spark, [(i, "x y") for i in range(700)]), F.lit(False)).first()
        assert got["train_tokens"] == 2100 and abs(got["score"]) < 0.01

    def test_disk(self, spark, monkeypatch):
        """Bytes shuffled and stored for each different triple; as 64-bit hashes of words and n-grams they were 53 and 23."""
        rng = np.random.default_rng(1)
        rows = [(i, " ".join(f"w{k}" for k in (20_000 * rng.random(1_000) ** 3).astype(int))) for i in range(200)]
        triples = {t for _, x in rows for w in [["<", "<", *x.split(), ">"]] for t in zip(w, w[1:], w[2:])}
        sent, map_arrow = [], kneser_ney.map_arrow
        monkeypatch.setattr(kneser_ney, "RANGE_CHARS", 300_000)
        monkeypatch.setattr(kneser_ney, "map_arrow", lambda df, function, schema: sent.append(map_arrow(df, function, schema)) or sent[-1])
        scratch = shared.Scratch(spark, "kneser-ney")
        kneser_ney.train(documents(spark, rows), scratch, 3)
        stored = sum(f.stat().st_size for f in (Path(urlparse(scratch.folder).path) / "model").iterdir())
        shuffled = sum(df.agg(F.sum(F.length("blob"))).first()[0] for df in sent)
        assert shuffled < 12 * len(triples) and stored < 15 * len(triples)

    @pytest.mark.parametrize(("n", "bits"), [(1, 1), (1, 64), (7, 3), (500, 12), (3000, 41), (3000, 64)])
    def test_tables(self, n, bits):
        rng = np.random.default_rng(n)
        own = lambda k: rng.integers(0, 2**bits - 1, k, np.uint64, endpoint=True)
        truth = {int(k): (i % 300 if n > 1000 else i % 3, 70_000 if i % 50 == 7 else 1, 2**40 + i if i % 70 == 8 else 0) for i, k in enumerate(np.unique(own(n)))}
        keys = np.array(sorted(truth), np.uint64)
        columns = kneser_ney.Table.columns(keys, [np.array(v, np.uint64) for v in zip(*(truth[int(k)] for k in keys))])
        table = kneser_ney.Table([*columns, np.zeros(3)])
        assert table.size == len(columns)
        asked = np.unique(np.concatenate([keys, own(1000), np.array([0, 2**bits - 1], np.uint64)]))
        hit, place = table.find(asked)
        assert asked[hit].tolist() == keys.tolist() and place.tolist() == list(range(len(keys)))
        assert list(zip(*(v.tolist() for v in table.at(place)))) == [truth[int(k)] for k in keys]
        assert [len(x) for x in table.find(asked[:0])] == [0, 0] and all(len(v) == 0 for v in table.at(place[:0]))
        assert len(set(kneser_ney.mixed(keys, bits).tolist())) == n or n > len(keys) == len(set(kneser_ney.mixed(keys, bits).tolist()))

    @pytest.mark.parametrize(("order", "width"), [(3, 32), (4, 32), (3, 40)])
    def test_keys_beyond_64_bits(self, spark, monkeypatch, corpus, order, width):
        def scores():
            return sorted((r["doc_id"] or -1, r["score"]) for r in kneser_ney.perplexities(documents(spark, corpus), F.coalesce(F.col("doc_id") % 3, F.lit(1)) == 0, order).collect())

        exact = scores()
        vocabulary = kneser_ney.vocabulary
        monkeypatch.setattr(kneser_ney, "vocabulary", lambda *x: dataclasses.replace(vocabulary(*x), width=width))
        assert np.allclose(scores(), exact, atol=1e-9)


class TestToxicity:
    def test_held_out_documents(self, spark):
        rng = np.random.default_rng(8)
        rows, labels = [], []
        for i in range(500):
            bad = i % 4 == 0
            sentences = [invented(rng, 8, 150) for _ in range(5)]
            if bad:
                sentences[2] += [" vileness", " Vilest", " rotter"][i % 3]
            rows.append((i, ". ".join(sentences)))
            labels.append((i, int(bad)))
        extra = [(900, None), (901, ""), (902, "w1 w2. Rotters vile-"), (None, "vileness")]
        held = F.col("doc_id") % 5 == 0
        got = toxicity.toxicity(documents(spark, rows + extra), spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int"), held).collect()
        truth = dict(labels)
        of = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and r["doc_id"] % 5 == 0]
        assert sum(p == t for p, t in of) >= 0.97 * len(of)
        found = next(r for r in got if r["doc_id"] == 20)["sentences"]
        text = dict(rows)[20]
        assert len(found) == 1 and "vil" in text[found[0]["start"] : found[0]["end"]].lower() or "rotter" in text[found[0]["start"] : found[0]["end"]].lower()
        assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)

    def test_no_labels(self, spark):
        labels = spark.createDataFrame([], "doc_id long, toxic int")
        assert [r["predicted"] for r in toxicity.toxicity(documents(spark, [(1, "a"), (2, None)]), labels, F.lit(False)).collect()] == [0, 0]
        assert toxicity.toxicity(documents(spark, []), labels, F.lit(False)).collect() == []


class TestImportance:
    def test_greatest(self, spark, monkeypatch):
        monkeypatch.setattr(importance, "FINE", 20)
        rng = np.random.default_rng(9)
        keys = [float(x) for x in np.round(rng.normal(size=800), 2)] + [1.5] * 100
        rows = list(zip(keys, range(900)))
        frame = spark.createDataFrame(rows, "key double, doc_id long").cache()
        for k in (0, 1, 37, 150, 450, 899, 900, 1000):
            got = importance.greatest(frame, k).collect()
            assert sorted((r["key"] for r in got), reverse=True) == sorted(keys, reverse=True)[:k]

    def test_prefers_what_is_like_the_target(self, spark):
        rng = np.random.default_rng(10)
        rows = [(i, invented(rng, 60, 200)) for i in range(200)] + [(500 + i, "### " + invented(rng, 60, 200).replace(" ", " ### ")) for i in range(40)] + [(900, None), (901, "")]
        labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(500 + i, 0) for i in range(20)], "doc_id long, quality int")
        kept = {r["doc_id"] for r in importance.resample(documents(spark, rows), labels).collect()}
        assert len(kept) == math.ceil(242 * 100 / 120) and {i for i, _ in rows if i < 500} <= kept | {900, 901}
        assert importance.resample(documents(spark, []), labels).collect() == []
        assert importance.resample(documents(spark, rows), labels.limit(0)).count() == len(rows)


class TestPacking:
    def test_ids_equal_the_tokenizers(self):
        from tokenizers import Tokenizer

        path = packing.tokenizer_path()
        plain, encode = Tokenizer.from_file(path), packing.encoder(path)
        texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "it's  'S we'll\t\tx", "<|endoftext|> x", "é 😀 ünï x  y", "1 22 333.4", "x" * 300, "Üb er\n\nzwei ", "a b c a b c", "\x1c \x85 z"]
        for t in texts * 2:
            assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)

    def test_pieces_and_places(self, spark, monkeypatch, corpus):
        monkeypatch.setattr(packing, "RANKED", 5)
        got = packing.pack(documents(spark, corpus), packing.tokenizer_path(), 64, carry_ids=True).collect()
        encode = packing.encoder(packing.tokenizer_path())
        expected = Counter()
        for i, x in corpus:
            ids = encode(x or "") + bytes(4)
            n = len(ids) // 4
            cuts = [0, *range((n - 1) % 64 + 1, n + 1, 64)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                expected[i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b]] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == expected
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in bins.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 64
        assert len(bins) <= 1.02 * math.ceil(sum(r["length"] for r in got) / 64)

    def test_fullest_is_the_best_sum(self):
        rng = np.random.default_rng(11)
        for _ in range(60):
            counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 30, 5)}
            room = int(rng.integers(1, 60))
            items = [x for x, n in counts.items() for _ in range(n)]
            best = max(s for r in range(len(items) + 1) for s in {sum(c) for c in itertools.combinations(items, r)} if s <= room)
            used = packing.fullest(counts, room)
            assert sum(x * n for x, n in used.items()) == best and all(n <= counts[x] for x, n in used.items())

    def test_empty_table(self, spark):
        assert packing.pack(documents(spark, []), packing.tokenizer_path()).collect() == []
