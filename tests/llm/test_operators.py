"""Every operator against its brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import math
import random
import re
import shutil
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from weft.llm import licenses, matroska, packing, pieces, quality, secrets, simhash, suffix, toxicity, urls

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)


def odd(spark, extra=()):
    """Nulls, empty, long, repeated and tied rows, and columns with names that operators use themselves."""
    text = " ".join(f"word{i % 97}" for i in range(30_000))
    rows = [(None, "some text here to be read"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, text), (6, "same words of a tie"), (6, "same words of a tie"), (7, "same words of a tie"), (7, "another text of that id"), (None, None), *extra]
    d = docs(spark, rows)
    for c in ("th", "key", "start", "n", "run", "shard", "terms", "fail_bits", "__gone", "__id", "__th", "__spans", "__measured", "media", "entry", "score", "a", "b"):
        d = d.withColumn(c, F.lit(f"clash {c}"))
    return d


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1


@pytest.mark.parametrize("length", [3, 8])
def test_suffix_equals_brute_force(spark, length):
    rng = random.Random(length)
    shared = [sentence(rng, n) for n in (length, length + 3, 4 * length)]
    rows = []
    for i in range(40):
        t = " ".join(rng.choice([sentence(rng, rng.randrange(1, 12), 6 if i % 5 == 0 else 400), rng.choice(shared)]) for _ in range(4))
        rows.append((i // 2 if i % 7 == 0 else i, t))
    rows += [rows[0], (99, "a " * 60), (100, "b"), (101, ""), (102, None), (None, rows[0][1])]
    got = {}
    for r in suffix.duplicated(docs(spark, rows), length=length).collect():
        got.setdefault((r.doc_id, r.th), []).append((r.start_word, r.end_word))
    hashes = {(r.doc_id, r.text): r.h for r in docs(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    by_hash = sorted({i for i, _ in rows if i is not None and len({t for j, t in rows if j == i}) > 1})
    want = {(i, hashes[i, t]): s for (i, t), s in brute.spans(rows, length).items()}
    for k in {*got, *want}:
        if k[0] not in by_hash:  # of texts that share an id, which comes first is a matter of their hashes
            assert sorted(got.get(k, [])) == want.get(k, []), k


def test_suffix_cuts(spark):
    rng = random.Random(1)
    passage = sentence(rng, 60)
    rows = [(1, f"é {passage}\nend"), (2, f"front ü\n{passage} back"), (3, passage), (4, passage)]
    got = {r.doc_id: r for r in suffix.cut_duplicates(docs(spark, rows)).collect()}
    want = brute.spans(rows, suffix.LENGTH)
    assert {i: r.text for i, r in got.items()} == {i: brute.cut(t, want.get((i, t), [])) for i, t in rows}
    assert got[4].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    d = odd(spark)
    out = suffix.cut_duplicates(d)
    assert out.columns == d.columns and out.count() == d.count()
    assert suffix.duplicated(d.limit(0)).count() == 0 and suffix.cut_duplicates(d.limit(0)).count() == 0


# 2


def test_toxicity_learns_pairs_and_words(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        words, kind = sentence(rng, 40, 800).split(), i % 5
        if kind == 0:
            words += ["scumbag"]
        elif kind == 1:
            words += ["frob", "quux"]  # toxic together only
        elif kind == 2:
            words += [rng.choice(["frob", "quux"])]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i < 1200:
            labels.append((i, 1, int(kind < 2)))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.is_toxic for r in toxicity.flag(docs(spark, rows), known).collect()}
    test = range(1200, 1500)
    hit = sum(got[i] and i % 5 < 2 for i in test)
    assert hit >= 0.9 * 120 and sum(got[i] and i % 5 >= 2 for i in test) <= 0.1 * 180


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(np.arange(20), 0.3, rng.normal(size=20), rng.normal(size=(20, toxicity.FACTORS)))
    rows = [rng.choice(20, n, replace=False) for n in (0, 1, 2, 7, 20)]
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    want = [0.3 + m.w[r].sum() + sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(r) for j in r[a + 1 :]) for r in rows]
    assert np.allclose(m.raw(np.concatenate(rows).astype(int), first), want)


def test_pairs_are_found_among_many_neutral_terms():
    """Two terms of which exactly one makes a text toxic, among 30,000 others: neither says anything alone."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({*rng.integers(1000, 31_000, 60).tolist()} | ({1} if a else set()) | ({2} if b else set()))))
        y.append(float(a != b))
    first, y, held = np.concatenate(([0], np.cumsum([len(r) for r in rows]))), np.array(y), np.arange(3000) % 7 == 0
    m = toxicity.train(np.concatenate(rows), first, y, held)
    right = (toxicity.logistic(m.raw(*m.look_up(np.concatenate(rows), first))) >= m.threshold) == (y > 0)
    assert {1, 2} <= {*m.terms.tolist()} and right[held].mean() > 0.9


def test_toxicity_does_not_depend_on_order(spark):
    """Rows of one doc_id with different texts, and repeated rows, in any order give the same scores."""
    rng = random.Random(9)
    rows = [(i % 150, sentence(rng, 20, 60) + (" vile folk" if i % 5 == 0 else "")) for i in range(300)]
    rows += rows[:40]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int")
    one = Counter((r.doc_id, round(r.toxicity, 9)) for r in toxicity.flag(docs(spark, rows), labels).collect())
    two = Counter((r.doc_id, round(r.toxicity, 9)) for r in toxicity.flag(docs(spark, rows[::-1]).repartition(5), labels).collect())
    assert one == two and sum(one.values()) == len(rows)


def test_toxicity_odd_rows(spark):
    d = odd(spark)
    labels = spark.createDataFrame([(5, 1, None), (6, 0, 0), (6, 0, 1), (None, 1, 1), (4, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.flag(d, labels).collect()
    assert len(out) == d.count() and all(0 <= r.toxicity <= 1 for r in out)
    assert not any(r.is_toxic for r in toxicity.flag(d, labels.limit(0)).collect())
    assert toxicity.flag(d.limit(0), labels).count() == 0


# 3


@pytest.mark.parametrize("value", ["password", "Password1", "qwerty123", "aaaaaaaa", "abcabcabc", "2024-01-31", "19990101x", "zxcvbn!", "f3ef4d6b2755", "P@ssw0rd2023", "x", "ñandú99", "monkeydragon", "tr0ub4dor&3"])
def test_guess_cost_is_the_least(value):
    cost, split = secrets.guess_cost(value)
    assert math.isclose(cost, brute.segmentation_cost(value), abs_tol=1e-9)
    assert sum(n for _, n in split) == len(value)


def test_secrets(spark):
    good = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'x token = "{good}" y'), (2, "password: changeme"), (3, f"é API_KEY={good}; api-key: 'Xk29!vLq0Zr7&w'"), (4, "token of thanks"), (5, f"{'long ' * 50_000}secret := {good}"), (6, 'password = "12345678"')]
    got = {(r.doc_id, r.start): r for r in secrets.scan(docs(spark, rows)).collect()}
    assert {k[0] for k, r in got.items() if r.is_secret} == {1, 3, 5} and len(got) == 6
    for (i, a), r in got.items():
        assert math.isclose(r.guesses_log10, brute.segmentation_cost(dict(rows)[i][a : a + r.n_chars]), abs_tol=1e-5)
    out = {r.doc_id: r for r in secrets.mask(docs(spark, rows)).collect()}
    assert {i: r.text for i, r in out.items()} == {i: brute.masked(t) for i, t in rows}
    assert good not in out[5].text and out[5].n_chars == len(out[5].text)
    d = odd(spark)
    assert secrets.scan(d).count() == 0 and secrets.mask(d).count() == d.count() and secrets.mask(d).columns == d.columns
    assert secrets.mask(d.limit(0)).count() == 0


def test_contexts_with_awkward_values(spark):
    """Searching all texts equals searching those that the JVM-side look finds."""
    rng = random.Random(33)
    bits = ["password", "API-key", "token", "ſecret", '"', "'", " ", "=", ":", ":=", "=>", "\t", "\n", "\u00a0", "é", "!", ",", ";", "Zx9#kQ2!vv8Lp", "abcdef", "04dbebab91ab85687d33"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    texts += [f"{name}{q}{sign}{r}{value}{r}" for name in ("pwd", "Secret_Key") for q in ("", '"') for sign in ("=", " : ") for r in ('"', "'", "") for value in (" correcthorse9X#zz", "'Zx9#kQ2!vv8Lp'", '"x"yyyyyy', "!!,,!!;;")]
    texts += ['password = " correcthorse9X#zz"', "password: \"'Zx9#kQ2!vv8Lp'\""]
    rows = list(enumerate(texts))
    found = Counter((r.doc_id, r.start, r.guesses_log10) for r in secrets.scan(docs(spark, rows)).collect())
    want = Counter((i, f[0], f[3]) for i, t in rows for f in secrets.findings(t))
    assert found == want and {len(texts) - 2, len(texts) - 1} <= {i for i, _, _ in want}
    assert {r.doc_id: r.text for r in secrets.mask(docs(spark, rows)).collect()} == {i: secrets.masked(t) for i, t in rows}


def test_secrets_of_repeated_rows_and_without_id(spark):
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    got = Counter(r.doc_id for r in secrets.scan(docs(spark, [(None, text), (1, text), (1, text)])).collect())
    assert got == {None: 1, 1: 2}


def test_repeats_and_walks_of_any_length():
    for value in ("abcdefghijklmnopq1" * 4, "Zx9#kQ2!vv8LpWm5$t" * 3, "qwqwqwqwqwqwqwqwqwqwpassword", "passpasspassword", "lkjhgfdsaasdfghjkl", "x" * 300 + "yz"):
        assert math.isclose(secrets.guess_cost(value)[0], brute.guesses(value), abs_tol=1e-9), value
    rng = random.Random(34)
    bits = ["pass", "password", "qwerty", "asdf", "1234567", "abcabc", "zxcvbnm", "2019", "12/05/1987", "aaaa", "xX9", "qwqwqw", "lkjhgf", "P@ssw0rd", "dragon"]
    for _ in range(500):
        value = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 6)))
        assert math.isclose(secrets.guess_cost(value)[0], brute.guesses(value), abs_tol=1e-9), value
    assert secrets.guess_cost("Zx9#kQ2!vv8LpWm5$" * 20_000)[0] < 50  # in seconds, not hours


# 4


def test_packets_cut_the_frames_out_again(spark):
    rng = random.Random(4)
    texts = ["", "\n\n", "one", *("\n".join("".join(chr(rng.choice([97, 233, 0x4E2D])) for _ in range(rng.choice([1, 7, 8, 100, 300, 1100, 5000]))) for _ in range(rng.randrange(1, 40))) for _ in range(25))]
    for text in texts:
        data = matroska.mux(text)
        rows, error = matroska.packets(data)
        assert error is None
        lines = {}
        for track, codec, cluster, ms, duration, key, lacing, frame, at, size, cue in rows:
            lines[ms // matroska.LINE_MS] = lines.get(ms // matroska.LINE_MS, b"") + data[at : at + size]
            assert key and cluster == ms // matroska.LINE_MS // matroska.CLUSTER and cue == (cluster % 2 == 0) and (codec == "S_TEXT/UTF8") == (track == 1) and (duration is not None) == (lacing == "ebml")
        assert [lines[i] for i in sorted(lines)] == [x.encode() for x in text.split("\n") if x]


def test_damaged_and_unknown_sizes(spark):
    data = matroska.mux("\n".join(f"line number {i}" for i in range(40)))
    whole, _ = matroska.packets(data)
    for n in range(0, len(data), 7):
        rows, error = matroska.packets(data[:n])
        assert error and [r[:-1] for r in rows] == [r[:-1] for r in whole[: len(rows)]]
    rng = np.random.default_rng(1)
    for _ in range(300):  # never anything but packets or an error
        b = np.frombuffer(data, np.uint8).copy()
        b[rng.integers(0, len(b), 4)] = rng.integers(0, 256, 4)
        matroska.packets(b.tobytes())
    at = data.index(b"\x18\x53\x80\x67") + 4
    length = 9 - data[at].bit_length()
    unknown = data[:at] + (((1 << 7 * length) - 1) | 1 << 7 * length).to_bytes(length, "big") + data[at + length :]
    assert matroska.packets(unknown) == (whole, None)


def element(ident, payload):
    return matroska._element(ident, payload)


def unsized(ident, payload):
    return ident.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + payload


def simple(track, time, payload=b"frame", flags=b"\x80"):
    return element(0xA3, bytes([0x80 | track]) + time.to_bytes(2, "big") + flags + payload)


def segment(*children):
    return matroska._HEADER + element(matroska.SEGMENT, matroska._FRONT + b"".join(children))


def test_numbers_beyond_bounds_are_damage(spark):
    good = element(matroska.CLUSTERS, matroska._uint(0xE7, 5) + simple(1, 1))
    scale = element(matroska.INFO, element(0x2AD7B1, b"\xff" * 8))
    for bad in (element(0xE7, b"\xff" * 8), element(0xE7, b"\x01" * 200)):
        rows, error = matroska.packets(segment(good, element(matroska.CLUSTERS, bad + simple(1, 1))))
        assert [r[3] for r in rows] == [6] and error
    assert matroska.packets(segment(scale, good, element(matroska.CLUSTERS, element(0xE7, b"\x7f" + b"\xff" * 7) + simple(1, 1))))[1]
    assert matroska.packets(segment(element(matroska.INFO, element(0x2AD7B1, b"\x00")), good)) == ([], matroska.packets(segment(element(matroska.INFO, element(0x2AD7B1, b"\x00"))))[1])
    big = 2**53 + 1  # more than a double holds
    assert matroska.packets(segment(element(matroska.CLUSTERS, matroska._uint(0xE7, big) + simple(1, 0))))[0][0][3] == big


def test_packets_before_damage_in_clusters_of_unknown_size():
    body = matroska._uint(0xE7, 0) + simple(1, 1) + simple(1, 2) + b"\xa3\x00broken"
    known, unknown = (matroska.packets(segment(make(matroska.CLUSTERS, body))) for make in (element, unsized))
    assert [r[3] for r in known[0]] == [r[3] for r in unknown[0]] == [1, 2] and known[1] and unknown[1]
    two = matroska._HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska._FRONT + unsized(matroska.CLUSTERS, matroska._uint(0xE7, 0) + simple(1, 1)) + unsized(matroska.CLUSTERS, matroska._uint(0xE7, 10) + simple(1, 2))
    assert [(r[2], r[3]) for r in matroska.packets(two)[0]] == [(0, 1), (1, 12)] and matroska.packets(two)[1] is None


def test_laces_take_the_default_duration_and_cues_stay_in_their_segment():
    track = element(matroska.TRACKS, element(0xAE, matroska._uint(0xD7, 3) + matroska._uint(0x23E383, 20_000_000)))
    lace = simple(3, 0, matroska._laced([b"aa", b"bbb", b"c"], 1), b"\x82")
    first = element(matroska.CLUSTERS, matroska._uint(0xE7, 100) + lace)
    rows, error = matroska.packets(matroska._HEADER + element(matroska.SEGMENT, track + first))
    assert [r[3] for r in rows] == [100, 120, 140] and error is None
    cue = element(matroska.CUES, element(0xBB, element(0xB7, matroska._uint(0xF1, 0))))
    two = matroska._HEADER + element(matroska.SEGMENT, first + cue) + element(matroska.SEGMENT, first)
    rows, error = matroska.packets(two)
    assert [(r[2], r[3], r[10]) for r in rows] == [(0, 100, True)] * 3 + [(1, 100, False)] * 3 and error is None


def test_damaged_bytes_never_fail_a_job(spark):
    data = np.frombuffer(matroska.mux("\n".join(f"line number {i} of the text" for i in range(24))), np.uint8)
    rng = np.random.default_rng(2)
    changed = []
    for k in range(10_000):
        b = data.copy()
        at, n = rng.integers(0, len(b)), rng.integers(1, 12)
        b[at : at + n] = 255 if k % 2 else rng.integers(0, 256, len(b[at : at + n]))
        changed.append((k, bytearray(b.tobytes())))
    got = matroska.packet_table(spark.createDataFrame(changed, "doc_id long, media binary"))
    assert got.agg(F.count_distinct("doc_id")).first()[0] == 10_000
    assert got.where("error IS NOT NULL AND (track IS NOT NULL OR size IS NOT NULL)").count() == 0


def test_packet_table_odd_rows(spark):
    d = odd(spark)
    out = matroska.packet_table(matroska.containers(d)).collect()
    assert not [r for r in out if r.error] and Counter(r.doc_id for r in out)[6] == 2
    assert {r.doc_id for r in out} == {None, 3, 4, 5, 6, 7}
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (None, bytearray(b""))], "doc_id long, media binary")
    assert {(r.doc_id, r.error) for r in matroska.packet_table(bad).collect()} == {(1, "no EBML header"), (None, "no EBML header")}
    assert matroska.packet_table(bad.limit(0)).count() == 0


# 5


def test_quality_equals_python(spark):
    rng = random.Random(5)
    texts = ["", None, "a b", "x " * 30, "A|B | C | D", "THE LOUD TEXT OF UPPER CASE!!", "#### $$$$ %%%%", "1 2 3 4 5 6", "l\nl\nl\nl\nl", "ünï cødé wörds are fine here", sentence(rng, 5000, 50), "w" * 500]
    rows = list(enumerate(texts)) + [(0, ""), (None, "some words in a row")]
    got = Counter((r.doc_id, r.fail_bits) for r in quality.ledger(docs(spark, rows)).collect())
    assert got == Counter((i, brute.fail_bits(t)) for i, t in rows)
    assert {r.doc_id: r.fail_bits for r in quality.ledger(docs(spark, rows)).collect()}[1] == 1
    d = odd(spark)
    kept = quality.keep(d)
    assert kept.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in d.collect() if not brute.fail_bits(r.text) & quality.POLICIES[quality.CURRENT])
    assert quality.keep(d.limit(0)).count() == 0


def test_a_later_policy_reads_the_stored_ledger(spark, tmp_path):
    """Decisions of old and new policies, and ablations, when the texts are gone."""
    texts = ["", "a b", "x " * 30, "#### $$$$ %%%%", "fine words make a fine text", "A | B | C | D", None]
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    led = quality.ledger(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    shutil.rmtree(tmp_path)
    bits = [brute.fail_bits(t) for t in texts]
    later = {"later": quality._mask("few_words", "menu_bars")}
    for r in quality.decide(led, later).collect():
        assert r.fail_bits == bits[r.doc_id]
        assert all(r[f"keeps_{v}"] == (not bits[r.doc_id] & mask) for v, mask in (quality.POLICIES | later).items())
    assert {(r.n_docs, r.n_rejected) for r in quality.ablation(led).collect() if r.policy == "v3"} == {(7, sum(b & quality.POLICIES["v3"] > 0 for b in bits))}


@pytest.mark.parametrize("n", [2000, 2001, 5000])
def test_variety_is_judged_at_all_lengths(spark, n):
    rng = random.Random(n)
    junk = "\n".join([" ".join(f"w{i % 7}" for i in range(n))])
    long_fine = sentence(rng, 20_000, 3_000)  # differing words: 0.15 of all, as long texts have
    kept = {r.doc_id for r in quality.keep(docs(spark, [(1, junk), (2, long_fine), (3, sentence(rng, n, 900))])).collect()}
    assert kept == {2, 3}


def test_ablation(spark):
    texts = ["", "a b", "x " * 30, "#### $$$$ %%%%", "fine words make a fine text", "A | B | C | D"]
    led = quality.ledger(docs(spark, list(enumerate(texts))))
    bits = [brute.fail_bits(t) for t in texts]
    for r in quality.ablation(led).collect():
        mask, bit = quality.POLICIES[r.policy], 1 << quality.BIT[r.rule]
        assert (r.n_rejected, r.n_failing, r.n_only, r.n_docs) == (sum(b & mask > 0 for b in bits), sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), len(bits))


# 6


def test_urls(spark):
    rows = [(1, "https://Bad.Example.com/x"), (2, "http://sub.bad.example.com:80/"), (3, "http://notbad.example.com/"), (4, None), (5, "no url"), (6, "http://user@ok.org/a/?q=1#f"), (7, "https://ok.org/a"), (8, "http://ok.org/b"), (None, "http://bad.example.com"), (9, ""), (10, "http:///path")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("strings", F.lit("clash"))
    got = {r.page_id: r.entry for r in urls.filter_pages(pages, ["bad.example.com"]).collect()}
    assert got == {1: "d:bad.example.com", 2: "d:bad.example.com", 3: None, 4: None, 5: None, 6: "u:ok.org/a", 7: "u:ok.org/a", 8: None, None: "d:bad.example.com", 9: None, 10: None}
    assert urls.filter_pages(pages.limit(0)).count() == 0
    entries = spark.createDataFrame([(None,), ("",), ("d:bad.example.com",), ("d:bad.example.com",)], "entry string")
    assert {r.page_id for r in urls.block(pages, urls.build(entries)).where("is_blocked").collect()} == {1, 2, None}
    assert urls.block(pages, urls.build(entries.limit(0))).where("is_blocked").count() == 0


def test_hosts(spark):
    rows = [(1, "http://spam-farm.example.com./x"), (2, "//spam-farm.example.com/x"), (3, "http://[::1]:80/x"), (4, "http://a.SPAM-FARM.example.com"), (5, "spam-farm.example.com"), (6, "http://[::1]/x/"), (7, "http://fine.example.com/" + "x" * 100_000)]
    got = {r.page_id: r.entry for r in urls.filter_pages(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: "d:spam-farm.example.com", 2: "d:spam-farm.example.com", 3: "u:[::1]/x", 4: "d:spam-farm.example.com", 5: None, 6: "u:[::1]/x", 7: None} or got[1] == got[2] == "u:spam-farm.example.com/x"


def test_collisions_are_told_apart(tmp_path):
    """Entries and probes that share a digest: the stored strings decide."""
    entries = [b"d:a.com", b"d:b.com"]
    np.array([5, 5], "<i8").tofile(tmp_path / "x.digest")
    np.array([0, 7, 14], "<i8").tofile(tmp_path / "x.offset")
    np.frombuffer(b"".join(entries), np.uint8).tofile(tmp_path / "x.string")
    probe = pa.array(["d:c.com", "d:b.com", "d:a.com", "d:a.com"])
    assert urls.lookup([(5, 5, str(tmp_path / "x"))], np.array([5, 5, 5, 6]), probe).tolist() == [False, True, True, False]


# 7


def test_licenses(spark):
    rows = [(i, f"front words {i} here.\n{t}\nand then some more text follows it") for i, t in enumerate(licenses.NOTICES.values())]
    rows += [(100, "nothing to see in this text"), (101, "Released under the\nMIT License of some kind, perhaps, by those who can"), (102, "RELEASED, under the MIT license!"), (103, "licensed under the apache licence version 2.0")]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(docs(spark, rows)).collect()}
    names = [n.split("#")[0] for n in licenses.NOTICES]
    for i, n in enumerate(names):
        assert got[i, n] == 1.0
    want = {}
    for i, t in rows:
        for unit in [t, *t.split("\n"), *re.split(r"(?<=[.!?])\s|\n", t), *re.split(r"\n\s*\n", t)]:
            scores = {key.split("#")[0]: 0.0 for key in licenses.NOTICES}
            for key, template in licenses.NOTICES.items():
                scores[key.split("#")[0]] = max(scores[key.split("#")[0]], brute.dice(unit, template))
            for key, x in scores.items():
                if x >= licenses.THRESHOLD and x == max(scores.values()):  # the best template of a unit
                    want[i, key] = max(want.get((i, key), 0.0), round(x, 6))
    assert got == want
    assert licenses.scan(odd(spark)).count() == 0 and licenses.scan(odd(spark).limit(0)).count() == 0


def test_versions_are_told_apart(spark):
    gpl3, gpl2 = licenses.NOTICES["GPL-3.0#1"], licenses.NOTICES["GPL-2.0#1"]
    wrapped = gpl2.replace("GNU ", "GNU\n")
    rows = [(1, gpl3), (2, f"front words.\n{gpl3}\nmore words"), (3, f"{gpl3}\nwords between them\n{gpl2}"), (4, f"{gpl3}\nwords between them and more\n{wrapped}\nand words after it"), (5, licenses.NOTICES["CC-BY-4.0#2"]), (None, gpl2), (6, gpl2), (6, gpl2)]
    got = Counter((r.doc_id, r.license) for r in licenses.scan(docs(spark, rows)).collect())
    assert got == {(1, "GPL-3.0"): 1, (2, "GPL-3.0"): 1, (3, "GPL-3.0"): 1, (3, "GPL-2.0"): 1, (4, "GPL-3.0"): 1, (4, "GPL-2.0"): 1, (5, "CC-BY-4.0"): 1, (None, "GPL-2.0"): 1, (6, "GPL-2.0"): 2}


@pytest.mark.parametrize("name", [*licenses.TEXTS])
def test_full_texts(name):
    """Words in an order that holds all bigrams of a full text, between other words."""
    edges = {}
    for gram in licenses.TEXTS[name].split("|"):
        a, b = gram.split(" ")
        edges.setdefault(a, []).append(b)
    path = []
    while edges:  # trails that use each bigram once; where two meet, a bigram is new
        at = next(iter(edges))
        path.append(at)
        while at in edges:
            nxt = edges[at].pop()
            if not edges[at]:
                del edges[at]
            path.append(at := nxt)
    got = {n: s for _, n, s, _ in licenses.matches(pa.array([" ".join(path)]))}
    assert got[name.split("#")[0]] > 0.8 and max(got, key=got.get) == name.split("#")[0]


def test_licenses_inside_longer_texts(spark):
    """A licence of several paragraphs, or a notice over several lines, is found between other text; the score is the best of all runs."""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    rng = random.Random(17)
    front, back = "\n".join(sentence(rng, 40) for _ in range(9)), "\n\n".join(sentence(rng, 80) for _ in range(9))
    rows = [(1, f"{front}\n\n{mit}\n\n{back}"), (2, f"{mit}\n{back}"), (3, f"{front}\nReleased under\nthe MIT License.\n{front}"), (4, f"{front}\n{mit[:300]}\n{back}")]
    got = {(r.doc_id, r.license): (r.dice, r.level) for r in licenses.scan(docs(spark, rows)).collect()}
    assert {*got} == {(1, "MIT"), (2, "MIT"), (3, "MIT")} and {level for _, level in got.values()} == {"run"}
    assert got[3, "MIT"][0] == 1.0
    for _ in range(200):  # runs cut by hand
        pieces = [[rng.randrange(6) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 9))]
        words = [x for p in pieces for x in p]
        template = {(rng.randrange(6), rng.randrange(6)) for _ in range(5)}
        best = 0.0
        for a in range(len(pieces)):
            for b in range(a, len(pieces)):
                run = [x for p in pieces[a : b + 1] for x in p]
                own = set(zip(run, run[1:], strict=False))
                best = max(best, 2 * len(own & template) / (len(own) + len(template)))
        score, _, _ = licenses._best_run(list(zip(words, words[1:], strict=False)), np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]), template, 0.6)
        assert score == best if best >= 0.6 else score < 0.6


# 8


def test_pieces_are_lossless_and_reproducible(spark):
    texts = ["", " ", "  two  spaces ", "plain words", "ünïcødé 中文 🎉", "▁marked▁", "line\nbreak\r\n\ttab", "a" * 3000, "\u0000", "x" * 7 + "é" * 500]
    rows = [*enumerate(texts), (3, texts[3]), (None, "null id"), (50, None)]
    enc = pieces.encode(docs(spark, rows))
    got = enc.collect()
    assert all(r.lossless for r in got if r.n_pieces is not None) and len(got) == len(rows)
    back = {r.doc_id: r.text for r in pieces.decode(enc).collect()}
    assert back == {i: t for i, t in rows}
    again = {r.doc_id: r.ids for r in pieces.encode(docs(spark, rows).repartition(7)).collect()}
    assert again == {r.doc_id: r.ids for r in got}
    other = {r.doc_id: r.ids for r in pieces.encode(docs(spark, rows), seed=1).collect()}
    assert other[7] != again[7]
    assert pieces.encode(odd(spark).limit(0)).count() == 0 and pieces.encode(odd(spark)).count() == odd(spark).count()


def test_long_units_have_the_same_lattice(monkeypatch):
    rng = random.Random(8)
    texts = pa.array([("abc" * 20 + "é中🎉▁" * 10) * 4, "".join(rng.choice("abcXYZ0189+/") for _ in range(3000)), "a" * 2000, "x" * 511 + "y", "short words"])
    keys = np.arange(5)
    m = pieces.load()
    long = pieces.sample(m, texts, keys)
    monkeypatch.setattr(pieces, "_BLOCK", 64)
    blocks = pieces.sample(m, texts, keys)
    monkeypatch.setattr(pieces, "LONG", 1 << 40)
    short = pieces.sample(m, texts, keys)
    assert all(np.array_equal(a, b) and np.array_equal(a, c) for a, b, c in zip(long, blocks, short, strict=True))
    monkeypatch.undo()
    text = "".join(rng.choice("abcXYZ0189+/") for _ in range(300_000))
    ids, first = pieces.sample(m, pa.array([text]), keys[:1])
    assert pieces.join(m, ids, first)[0][1:].tobytes().decode() == text


def test_pieces_are_drawn_by_weight():
    m = pieces.load()
    n = 20_000
    ids, first = pieces.sample(m, pa.array(["then"] * n), np.arange(n, dtype=np.int64))
    seen = Counter(tuple(ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True))
    known = {m.data[a:b].tobytes(): i for i, (a, b) in enumerate(zip(m.offs[:-1], m.offs[1:], strict=True)) if i not in set(m.byte_id.tolist())}

    def walks(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in known:
                for tail in walks(rest[k:]):
                    yield (known[rest[:k]], *tail)

    weight = {w: math.exp(sum(m.weight[i] for i in w)) for w in walks(b" then")}
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for w, x in weight.items():
        p = x / total
        assert abs(seen[w] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


# 9


def test_simhash_equals_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        base = sentence(rng, rng.randrange(5, 120)).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(rng.randrange(4)):
            for _ in range(k):
                base[rng.randrange(len(base))] = f"new{rng.randrange(1000)}"
            rows.append((10 * i + k + 1, " ".join(base).upper() + "."))
    rows += [(1000, ""), (1001, None), (None, rows[0][1]), (1002, "w"), (1003, "W!")]
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    want = brute.groups(rows)
    assert sum(got.get(i) == k for i, k in want.items()) >= 0.95 * len(want)
    assert all(i in want for i in got)
    assert got[1003] == 1002
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.count() == len(rows) - len(got)


def test_blocks_are_exact():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, (6, 4)).astype(np.uint64)
    fp = centre[rng.integers(0, 6, 300)].copy()
    for _ in range(45):
        fp[np.arange(300), rng.integers(0, 4, 300)] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    i, j = simhash.block_edges(fp)
    assert (simhash.hamming(fp[i], fp[j]) <= simhash.RADIUS).all()

    def parts(pairs):
        root = list(range(300))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        label = {}
        return [label.setdefault(find(x), len(label)) for x in range(300)]

    every = [(a, b) for a in range(300) for b in range(a) if simhash.hamming(fp[a], fp[b]) <= simhash.RADIUS]
    assert parts(zip(i.tolist(), j.tolist(), strict=True)) == parts(every)


def test_simhash_odd_rows(spark):
    d = odd(spark)
    assert {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(d).collect()} == {7: 6}
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2})
    assert simhash.drop_near_duplicates(d.limit(0)).count() == 0


# 10


def windows(df):
    return sorted([(i, s, n) for i, s, n in zip(r.doc_ids, r.starts, r.lengths, strict=True)] for r in df.collect())


@pytest.mark.parametrize("shard", [1000, 20])
def test_packing_equals_brute_force(spark, shard):
    rng = random.Random(shard)
    rows = [(i, sentence(rng, rng.randrange(1, 140), 60)) for i in range(90)] + [(500, ""), (501, None), (None, "x y")]
    got = windows(packing.pack(docs(spark, rows), window=100, shard_docs=shard))
    n = -(-90 // shard)
    key = {r.doc_id: r.k for r in docs(spark, rows).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("k")).collect()}
    assert got == sorted(brute.packed(rows, 100, key.get))
    covered = Counter((i, w) for pack in got for i, s, k in pack for w in range(s, s + k))
    assert covered == Counter((i, w) for i, t in rows if i is not None for w in range(len((t or "").split())))


def test_packing_searches_all_shards(spark, monkeypatch):
    """Windows are those of one index, however many shards hold it and however short their answers are; an exact copy is found among more than 2,048 documents."""
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.randrange(1, 140), 60)) for i in range(150)]
    key = sorted(brute.packed(rows, 100, lambda i: 0))
    for seeds, head in ((256, 512), (7, 1)):
        monkeypatch.setattr(packing, "SEEDS", seeds)
        monkeypatch.setattr(packing, "HEAD", head)
        assert windows(packing.pack(docs(spark, rows).repartition(5), window=100)) == key
    monkeypatch.undo()
    rows = [(i, f"{sentence(rng, 3, 9)} only{i % 1500} again{i % 1500}") for i in range(3000)]
    got = windows(packing.pack(docs(spark, rows).repartition(4), window=10))
    assert sorted(sorted(i for i, _, _ in w) for w in got) == [[i, i + 1500] for i in range(1500)]


@pytest.mark.parametrize(("seeds", "head", "stays", "tasks", "short"), [(256, 512, 0.8, 64, 2048), (7, 1, 0.99, 2, 3), (5, 16, 0.5, 1, 10), (64, 8, 0.9, 2, 0)])
def test_packing_by_every_nth_row_equals_brute_force(spark, monkeypatch, seeds, head, stays, tasks, short):
    """Seeds that take their share of all documents; the Greek ones share no word with a seed, and are packed all the same."""
    rng = random.Random(14)
    rows = [(i, sentence(rng, rng.randrange(1, 140), 60)) for i in range(1, 160)] + [(0, sentence(rng, 100)), (40, sentence(rng, 30, 60))]
    rows += [(1001 + 10 * i, " ".join(rng.choice("αβγδε") for _ in range(rng.randrange(1, 60)))) for i in range(12)] + [(70, "ζ"), (80, None)]
    for name, x in (("SEEDS", seeds), ("HEAD", head), ("STAYS", stays), ("TASKS", tasks), ("SHORT", short)):
        monkeypatch.setattr(packing, name, x)
    got = windows(packing.pack(docs(spark, rows).repartition(5), window=100, every=10))
    assert got == sorted(brute.packed(rows, 100, lambda _: 0, every=10))
    covered = Counter((i, w) for pack in got for i, s, k in pack for w in range(s, s + k))
    assert covered == Counter((i, w) for i, t in rows for w in range(len((t or "").split())))


def test_packing_answers_stay_small_whatever_the_shards(spark, monkeypatch):
    """Entries that reach the driver are bounded by tasks, not by shards."""
    rng = random.Random(16)
    rows = [(i, sentence(rng, rng.randrange(1, 100), 30)) for i in range(600)]
    entries = []
    ask = packing._Corpus.ask

    def counted(self, seeds, head):
        found = ask(self, seeds, head)
        entries.extend((len(r[0]), head * packing.TASKS * len(r[2])) for r in found)
        return found

    for name, x in (("SHORT", 0), ("HEAD", 8), ("TASKS", 2)):
        monkeypatch.setattr(packing, name, x)
    monkeypatch.setattr(packing._Corpus, "ask", counted)
    got = windows(packing.pack(docs(spark, rows).repartition(30), window=200, every=50))
    assert got == sorted(brute.packed(rows, 200, lambda _: 0, every=50))
    assert entries and all(n <= most for n, most in entries)


def test_packing_asks_once_for_many_windows_and_leaves_a_small_index(spark, monkeypatch):
    """Rows whose doc_id 50 divides are asked for, and few others: what shares no word with the last of them. The files take under 20 bytes a posting."""
    rng = random.Random(15)
    rows = [(i, sentence(rng, 40, 400)) for i in range(1000)]
    asked, taken = [], []
    ask = packing._Corpus.ask

    def counted(self, seeds, head):
        asked.extend(seeds.tolist())
        taken.append(sum(p.stat().st_size for at in self.at for p in Path(at).rglob("*.npy")))
        return ask(self, seeds, head)

    monkeypatch.setattr(packing._Corpus, "ask", counted)
    got = windows(packing.pack(docs(spark, rows).repartition(2), window=200, every=packing.EVERY))
    assert sorted(i for w in got for i, _, _ in w) == list(range(1000))
    assert set(asked) >= set(range(0, 1000, 50)) and len(asked) <= 40 and len(got) >= 200
    assert taken[0] < 20 * sum(len(set(t.split())) for _, t in rows)


def test_packing_search_takes_no_more_tasks_than_cores(spark, monkeypatch):
    """However many shards; their heads, merged in the tasks, give the windows of one index."""
    rng = random.Random(17)
    rows = [(i, sentence(rng, int(min(190, rng.lognormvariate(3, 0.8))) + 1, 60)) for i in range(3000)]
    tasks, parallelize = [], type(spark.sparkContext).parallelize

    def dealt(self, c, numSlices=None):
        tasks.append(numSlices or 0)
        return parallelize(self, c, numSlices)

    monkeypatch.setattr(packing, "SHORT", 0)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", dealt)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")  # a shard for each file
    try:
        got = windows(packing.pack(docs(spark, rows).repartition(30), window=200, every=50))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(brute.packed(rows, 200, lambda _: 0, every=50))
    assert any(tasks) and max(tasks) <= spark.sparkContext.defaultParallelism


def test_packing_odd_rows(spark):
    d = odd(spark)
    covered = Counter()
    for pack in windows(packing.pack(d, window=50)):
        assert sum(k for *_, k in pack) <= 50
        covered.update(i for i, _, k in pack for _ in range(k))
    assert covered == Counter({4: 1, 5: 30_000, 6: 10, 7: 10})
    assert packing.pack(d.limit(0)).count() == 0


# pipeline


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    passage = sentence(rng, 70)
    rows = [(i, sentence(rng, rng.randrange(20, 200))) for i in range(60)]
    rows += [(100 + i, t + " extra") for i, t in rows[:10]] + [(200 + i, f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}") for i in range(5)]
    rows += [(300, "#### $$$$ %%%% ****"), (301, "a | b | c | d"), (302, None), (303, ""), (None, sentence(rng, 40)), (304, f'{sentence(rng, 30)} token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"')]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = windows(corpus_pipeline.run(spark, str(tmp_path)))
    kept = [(i, t) for i, t in rows if not brute.fail_bits(t) & quality.POLICIES[quality.CURRENT]]
    gone = brute.groups(kept)
    kept = [(i, t) for i, t in kept if i not in gone]
    assert set(gone) >= {100 + i for i in range(10)} and not {i for i in gone if i < 100}
    found = brute.spans(kept, suffix.LENGTH)
    kept = [(i, brute.masked(brute.cut(t, found.get((i, t), [])))) for i, t in kept]
    assert got == sorted(brute.packed(kept, packing.WINDOW, lambda _: 0, every=packing.EVERY))
    d = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns, name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0, name
