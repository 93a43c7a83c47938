"""SimHash components, line runs, winnowing and license scans against brute force, with odd inputs."""
import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from floodlens.llm import licences, line_runs, simhash, winnow
from floodlens.llm.common import linked_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "One two", None, "a", 7),
       (4, "One two", None, "a", 7), (None, "null id", "en", None, 7), (5, "x" * 300_000, "en", "a", 1),
       (6, "word " * 60_000, "en", "a", 1), (7, "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 40, "en", "a", 1)]


def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    names = ("fp", "k", "pos", "rank", "key", "component_id", "__n", "at", "word", "runs")
    df = spark.createDataFrame(ODD, DOCS)
    return df.select("*", *[F.lit("clash").alias(n) for n in names])


def plain_fingerprint(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("max_bits,key_rows", [(4, 4096), (4, 3), (2, 4096), (0, 4096), (6, 5)])
def test_links_give_the_components_of_all_pairs(spark, max_bits, key_rows):
    rng, fps = random.Random(max_bits), set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(14):
            flips = rng.sample(range(64), rng.randint(0, 7))
            fps.add(seed ^ sum(1 << b for b in flips))
            seed ^= 1 << rng.randrange(64)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bits, key_rows)
    found = dict(linked_components(links).collect())
    near = plain_components(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits)
    assert {n: found.get(n, n) for n in signed} == near


def test_a_key_of_many_probes_and_few_own_rows(spark):
    rng = random.Random(8)
    start = rng.getrandbits(64) & ~(((1 << 13) - 1) << 12)  # the second segment's bits are clear: even, so these rows probe
    crowd = {start ^ rng.getrandbits(39) << 25 for _ in range(300)}
    few = {x ^ 1 << 12 for x in sorted(crowd)[:5]}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in crowd | few)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    found = dict(linked_components(links).collect())
    near = plain_components(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)
    assert {n: found.get(n, n) for n in signed} == near and len(found) >= 5


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = dict(linked_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 201: 200}


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert {i: f"{x:016x}" for i, x in fps.items()} == {i: r.fingerprint for i, r in rows.items()}
    assert plain_components(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4) == {i: r.component_id for i, r in rows.items()}
    kept = simhash.drop_near_duplicates(docs, 4).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in rows.values()})


def test_near_duplicates_of_odd_rows(spark):
    found = simhash.near_duplicates(odd(spark)).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 1
    assert by[None].component_id is None and by[4].component_id == 4
    assert by[6].fingerprint == f"{plain_fingerprint('word ' * 5):016x}"
    kept = simhash.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 4, 5, 6, 7)] + [(True, 0)]
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == simhash.drop_near_duplicates(odd(spark).limit(0)).count() == 0


def plain_deleted(docs, min_words):
    """Positions in a block of lines that holds min_words words and occurs at an earlier place as well."""
    places = [(d, i) for d in range(len(docs)) for i in range(len(docs[d]))]
    gone = set()
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            run = 0
            while i + run < len(docs[d]) and j + run < len(docs[e]) and docs[d][i + run] == docs[e][j + run]:
                run += 1
            if sum(len(x.split()) for x in docs[d][i:i + run]) >= min_words:
                gone.update((d, i + r) for r in range(run))
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_line_runs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["a", "b b", "c c c", "", "d d d d", "e " * 9]
    docs = [[rng.choice(lines[: 3 + seed]) for _ in range(rng.randint(1, 24))] for _ in range(9)] + [["c c c"] * 17]
    frame = spark.createDataFrame([(i, "\n".join(d), None, None, 0) for i, d in enumerate(docs)], DOCS)
    gone = plain_deleted(docs, 8)
    want = {i: "\n".join(x for j, x in enumerate(d) if (i, j) not in gone) for i, d in enumerate(docs)}
    assert {r.doc_id: r.text for r in line_runs.drop_repeated_lines(frame, 8).collect()} == want
    counts = line_runs.repeated_line_counts(frame, 8).collect()
    assert {r.doc_id: r.kept_lines for r in counts} == {i: sum((i, j) not in gone for j in range(len(d))) for i, d in enumerate(docs)}
    assert {(r.doc_id, j) for r in counts for s in r.runs for j in range(s.start, s.end + 1)} == gone


def test_line_runs_of_odd_rows(spark):
    docs = odd(spark).union(odd(spark).where("doc_id = 6").withColumn("doc_id", F.lit(60).cast("long")))
    out = line_runs.drop_repeated_lines(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and out.count() == len(ODD) + 1
    assert rows[1].text is None and rows[6].text == "word " * 60_000 and rows[60].text == "" and rows[60].n_chars == 0
    assert line_runs.drop_repeated_lines(docs.limit(0)).count() == line_runs.repeated_line_counts(docs.limit(0)).count() == 0


def plain_selection(text, k, window):
    w = winnow.Winnower(k, window)
    codes = np.array([ord(c) for c in text], "<u4")
    grams = [int(w._grams(codes[i:i + k])[0]) for i in range(max(1, len(codes) - k + 1))] if text else []
    out = {}
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        part = grams[i:i + window]
        low = min(part)
        at = max(j for j, g in enumerate(part) if g == low)
        out[i + at] = low
    return sorted(out.items())


def test_selections_equal_brute_force_and_keep_their_guarantee():
    rng = random.Random(3)
    for n in (0, 1, 5, 11, 12, 30, 43, 44, 200, 900):
        text = "".join(rng.choice("ab é😀") for _ in range(n))
        at, h = winnow.Winnower(12, 32).selections(text)
        assert list(zip(at.tolist(), h.tolist())) == plain_selection(text, 12, 32)
    shared = "".join(rng.choice("abcdefgh") for _ in range(43))
    a, b = ("".join(rng.choice("xyz") for _ in range(70)) + shared + x * 50 for x in "pq")
    assert set(winnow.Winnower().fingerprint(a)) & set(winnow.Winnower().fingerprint(b))


def test_blocks_do_not_change_selections(monkeypatch):
    text = "".join(random.Random(5).choice("abcd ") for _ in range(5000))
    whole = winnow.Winnower().selections(text)
    monkeypatch.setattr(winnow, "_BLOCK", 700)
    assert all((x == y).all() for x, y in zip(whole, winnow.Winnower().selections(text)))


@pytest.mark.parametrize("range_rows,ranges", [(3, 20_000), (4096, 20_000), (3, 5)])
def test_edited_likeness_equals_brute_force(spark, monkeypatch, range_rows, ranges):
    monkeypatch.setattr(winnow, "RANGES", ranges)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    found = {r.doc_id: r for r in winnow.edited_likeness(docs, range_rows=range_rows).collect()}
    w = winnow.Winnower()
    assert len(found) == len(rows)
    for own, after in zip(rows, rows[1:] + rows[:1]):
        n = len(own.text)
        edited = own.text[: n - n // 3] + after.text[: n // 3]
        a, b, c = (set(w.fingerprint(x).tolist()) for x in (own.text, edited, after.text))
        r = found[own.doc_id]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:08x}" for x in sorted(a)) and r.edited_fingerprint == "".join(f"{x:08x}" for x in sorted(b))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))


def test_edited_likeness_of_odd_rows(spark):
    found = winnow.edited_likeness(odd(spark), range_rows=2).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    assert by[1].fingerprint == by[2].fingerprint == "" and by[2].near_next == 1.0 and 0 < by[6].near_edited < 1
    assert winnow.edited_likeness(odd(spark).limit(0)).count() == 0
    assert odd(spark).select(winnow.selections_column(F.col("text")).alias("s")).where("size(s) > 0").count() == 7


def test_license_scan(spark):
    notice = licences.TEMPLATES["Apache-2.0"][1]
    texts = [f"A line.\n{notice[:90]}\n{notice[90:]}\nEnd.", "Released under the MIT License.", "The licensed plumber came.",
             notice.replace("not use", "use").replace("comply", "accord"), "licensed " * 40, None, "",
             "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", "x" * 200_000 + "\nThis work is licensed under the GNU General Public License, version 3."]
    rows = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {(r.doc_id, r.first_line): (r.license, r.last_line, r.missing, r.inserted) for r in rows}
    assert found[0, 1] == ("Apache-2.0", 2, 0, 0) and found[1, 0][0] == "MIT" and found[3, 0][0] == "Apache-2.0" and found[3, 0][2] > 0
    assert found[7, 0][0] == "CC-BY-NC-4.0" and found[7, 1][0] == "CC-BY-4.0" and found[8, 1][0] == "GPL-3.0" and len(found) == 6
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n"))).where("col rlike '^(Licensed under|Released under|This work is licensed)'")
    assert {(r.doc_id, r.first_line) for r in licences.scan_licences(docs).collect()} == {(r.doc_id, r.pos) for r in lines.collect()}
    assert licences.scan_licences(odd(spark)).count() == licences.scan_licences(docs.limit(0)).count() == 0


def test_license_notices_inside_lines_and_variants():
    scanner, pad = licences.Scanner(), "Copyright (c) 2020 Jane Doe and contributors to the project, all files here. "
    names = lambda text: [f[0] for f in scanner.scan(text)]
    assert names(f"{pad}Released under the MIT License.") == names("Licensed under the MIT License.") == ["MIT"]
    for t in scanner.templates:
        assert names("one " * 300 + " ".join(t.words) + " two" * 300) == [t.name]
        for i, cost in enumerate(t.costs):
            if cost == 1 and i not in t.places:
                assert names(f"{pad}{' '.join(t.words[:i] + t.words[i + 1:])} {pad}") == [t.name]
    for other in ("Affero", "Lesser"):
        assert not names(f"This work is licensed under the GNU {other} General Public License, version 3.")
        assert not names(licences.TEMPLATES["GPL-3.0"][1].replace("GNU General", f"GNU {other} General"))
    assert names(licences.TEMPLATES["GPL-3.0"][1].replace("version 3", "version 2")) == ["GPL-2.0"]
    assert not names("Licensed under CC BY-ND 4.0.") and not names("Licensed under the GNU GPL, version 2.1.")
    assert names("Released under the MIT License. Licensed under CC BY-NC 4.0.") == ["MIT", "CC-BY-NC-4.0"]


def test_license_scan_in_pieces(monkeypatch):
    text = "\n".join(f"{'word ' * (i % 97)}Released under the BSD License. {'x ' * (i % 13)}" for i in range(300))
    whole = licences.Scanner().scan(text)
    monkeypatch.setattr(licences, "HELD", 5)
    assert licences.Scanner().scan(text) == whole and [f[1] for f in whole] == list(range(300))


def test_single_repeated_lines_are_runs(spark):
    docs = [["one", "two words", "", "mine"], ["yours", "two words", "", "own"], ["one", "last"], ["two words"]]
    frame = spark.createDataFrame([(i, "\n".join(d), "en", "s", 0) for i, d in enumerate(docs)], DOCS)
    kept = {r.doc_id: r.text.split("\n") for r in line_runs.drop_repeated_lines(frame).collect()}
    assert kept == {0: docs[0], 1: ["yours", "own"], 2: ["last"], 3: [""]}
    assert {r.doc_id: r.kept_lines for r in line_runs.repeated_line_counts(frame).collect()} == {0: 4, 1: 2, 2: 1, 3: 0}
