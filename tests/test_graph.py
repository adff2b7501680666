"""Merges, passes, search, dedup, snapshots, ingestion and streaming on small graphs, against plain Python."""

from __future__ import annotations

import json
import math
import os
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weft.functions import names
from weft.functions.extract import JsonExtractor, Retried, RuleExtractor
from weft.operators import components, dream, fuzzy, graph, health, ingest, merge, recall, search
from weft.operators.graph import Graph
from weft.sources import files, jsonl
from weft.sources.store import Store
from weft.streaming import ingest as stream

T0 = datetime(2024, 1, 1)


def entities(spark, rows):
    """rows: name, confidence, mentions and what else is given by name."""
    full = []
    for name, confidence, mentions, *more in rows:
        x = {"entity_id": f"id-{name}", "type": "concept", "domain": "general", "first_seen": T0, "last_seen": T0, "description": "", "aliases": [], "session_id": None, "created_at": T0, "canonical_name": None} | (more[0] if more else {})
        full.append((x["entity_id"], name, x["type"], x["domain"], confidence, mentions, x["first_seen"], x["last_seen"], x["description"], x["aliases"], x["session_id"], x["created_at"], x["canonical_name"]))
    return spark.createDataFrame(full, graph.ENTITY)


def edges(spark, rows):
    return spark.createDataFrame([(*r, "doc", T0) for r in rows], graph.EDGE)


def world(spark, e, r):
    e = entities(spark, e)
    return Graph(e, edges(spark, r), e.select("entity_id", F.lit("m").alias("memory_id")))


def test_upsert_rules(spark):
    store = entities(spark, [("Acme", 0.5, 2, {"description": "old"})]).withColumn("canonical_name", names.canonical(F.col("name"), "loose"))
    rows = [("Acme", 0.4, "new", 1), ("Acme Inc.", 0.9, "not mine", 2), ("Acme", 0.3, "", 3), ("Zed", 0.6, "z", 4), ("ZED", 0.7, "other", 5), ("Zed", 0.1, "zz", 6)]
    batch = spark.createDataFrame([(n, "tool", "work", c, d, [], "s", T0, i) for n, c, d, i in rows], "name string, type string, domain string, confidence double, description string, aliases array<string>, session_id string, seen_at timestamp, seq long")
    got = {r.name: r for r in merge.upsert_entities(store, batch).collect()}
    assert set(got) == {"Acme", "Zed"}
    assert (got["Acme"].mention_count, got["Acme"].confidence, got["Acme"].description, got["Acme"].type) == (5, 0.9, "new", "concept")
    assert (got["Zed"].mention_count, got["Zed"].confidence, got["Zed"].description, got["Zed"].type) == (3, 0.7, "zz", "tool")
    registered = {r.name for r in merge.register(entities(spark, []), batch).collect()}
    assert registered == {"Acme", "Zed"}
    assert merge.upsert_entities(store, batch.limit(0)).count() == 1


def test_delete_and_links(spark):
    g = world(spark, [("A", 0.5, 1), ("B", 0.5, 1)], [("A", "B", "uses", 0.5), ("B", "B", "uses", 0.5)])
    left = merge.delete_entities(g, spark.createDataFrame([("A",)], "name string"))
    assert [r.name for r in left.entities.collect()] == ["B"]
    assert left.relationships.count() == 1 and left.memory_ids.count() == 1
    assert merge.link_memory(g.memory_ids, g.memory_ids).count() == 2
    states = merge.update_sessions(graph.empty(spark, "session_state"), spark.createDataFrame([("s", 3, T0, 1), ("s", 5, T0, 2)], "session_id string, msg_index long, at timestamp, seq long"))
    assert states.first().asDict() == {"session_id": "s", "last_extracted_msg_index": 5, "last_extraction_at": T0, "total_extractions": 2}


def test_sync_is_first_come_first_served(spark):
    store = entities(spark, [("A", 0.1, 1)])
    rows = [("B", "i1"), ("C", "i1"), ("C", "i2"), ("D", "i2"), ("A", "i9"), ("E", "i5"), ("E", "i5")]
    new = entities(spark, [(n, 0.5 + k / 100, 1, {"entity_id": i}) for k, (n, i) in enumerate(rows)])
    new = new.withColumn("seq", F.round((F.col("confidence") - 0.5) * 100).cast("long"))
    got = {(r.name, r.entity_id) for r in merge.sync_first_wins(store, new).collect()}
    held_n, held_i, want = {"A"}, {"id-A"}, {("A", "id-A")}
    for n, i in rows:
        if n not in held_n and i not in held_i:
            held_n.add(n)
            held_i.add(i)
            want.add((n, i))
    assert got == want
    last = {(r.name, r.entity_id) for r in merge.import_last_wins(store, new).collect()}
    assert ("A", "i9") in last and ("A", "id-A") not in last and ("B", "i1") not in last


def test_decay(spark):
    e = entities(spark, [("A", 0.5, 1), ("B", 0.152, 1), ("C", 0.15, 1), ("D", 0.5, 1, {"last_seen": datetime(2024, 1, 30)})])
    now = datetime(2024, 1, 31)
    got = {r.name: round(r.confidence, 6) for r in dream.decay(e, now).collect()}
    assert got == {"A": 0.475, "B": 0.15, "C": 0.15, "D": 0.5}
    assert {r.name: round(r.confidence, 6) for r in dream.scheduled_decay(e, now).collect()}["B"] == 0.1444
    ids = spark.createDataFrame([("id-A",)], "entity_id string")
    assert {r.name: r.confidence for r in dream.decay_ids(e, ids, 0.5).collect()}["A"] == 0.25
    assert dream.decay_ids(e, ids, 1.5) is e
    assert dream.decay_due(None, now) and not dream.decay_due(now - timedelta(hours=5), now)


def test_dedup_pairwise_and_reference(spark):
    e = [("foo", 0.9, 1), ("Foo Inc.", 0.4, 2, {"aliases": ["f"]}), ("bar", 0.5, 1)]
    r = [("foo", "bar", "uses", 0.9), ("foo", "bar", "owns", 0.8), ("Foo Inc.", "bar", "uses", 0.2), ("foo", "Foo Inc.", "uses", 0.3), ("foo", "qux", "uses", 0.3)]
    g = dream.dedup(world(spark, e, r))
    top = {x.name: x for x in g.entities.collect()}
    assert set(top) == {"Foo Inc.", "bar"}
    assert (top["Foo Inc."].mention_count, top["Foo Inc."].confidence, top["Foo Inc."].aliases) == (3, 0.9, ["f", "foo"])
    got = {(x.source_name, x.target_name, x.rel_type): x.confidence for x in g.relationships.collect()}
    assert got == {("Foo Inc.", "bar", "uses"): 0.9, ("Foo Inc.", "bar", "owns"): 0.8, ("Foo Inc.", "Foo Inc.", "uses"): 0.3, ("Foo Inc.", "qux", "uses"): 0.3}
    assert g.memory_ids.count() == 2
    again = dream.dedup(g)
    assert again.entities.count() == 2 and again.relationships.count() == 4
    ref = {(x.source_name, x.target_name, x.rel_type) for x in dream.dedup(world(spark, e, r), "reference").relationships.collect()}
    assert ref == {("Foo Inc.", "bar", "uses"), ("Foo Inc.", "bar", "owns"), ("Foo Inc.", "Foo Inc.", "uses"), ("Foo Inc.", "qux", "uses")} - {("Foo Inc.", "bar", "none")}


def test_prune_infer_closure(spark):
    g = world(spark, [("A", 0.1, 1), ("B", 0.1, 2), ("C", 0.5, 1), ("D", 0.5, 1)], [("A", "B", "part_of", 0.5), ("B", "C", "part_of", 0.5), ("C", "D", "part_of", 0.5), ("B", "D", "uses", 0.5)])
    left = dream.prune(g)
    assert {r.name for r in left.entities.collect()} == {"B", "C", "D"} and left.relationships.count() == 3 and left.memory_ids.count() == 3
    assert dream.prune(left).relationships.count() == 3
    new = {(r.source_name, r.target_name) for r in dream.inferred(g.relationships).collect()}
    assert new == {("A", "C"), ("B", "D")}
    full = {(r.source_name, r.target_name) for r in dream.closure(g, T0).relationships.where("rel_type = 'part_of'").collect()}
    assert full == {("A", "B"), ("B", "C"), ("C", "D"), ("A", "C"), ("B", "D"), ("A", "D")}


def test_strengthen(spark):
    e = entities(spark, [(n, 0.5, 1, {"session_id": "s"}) for n in "ABC"] + [("D", 0.5, 1)])
    got = {r.name: round(r.confidence, 6) for r in dream.strengthen(e, dream.boosts_by_session(e, 1)).collect()}
    assert got == {"A": 0.6, "B": 0.6, "C": 0.6, "D": 0.5}
    assert dream.boosts_by_session(e).count() == 0
    m = spark.createDataFrame([(f"id-{n}", s) for s in range(5) for n in "AB"] + [("id-C", 0), ("id-C", 1), (None, 2)], "entity string, session long")
    got = {r.name: round(r.confidence, 6) for r in dream.strengthen(e, dream.boosts_by_mentions(m)).collect()}
    assert got == {"A": 0.7, "B": 0.7, "C": 0.5, "D": 0.5}


def test_cycle_records_failures(spark):
    g = world(spark, [("A", 0.5, 1), ("The A", 0.5, 1)], [("A", "The A", "uses", 0.5)])
    after, report = dream.cycle(g, T0)
    assert [s for _, s in report] == ["done"] * 5 + ["skipped", "done"]
    assert after.entities.count() == 1
    bad = g.with_(entities=g.entities.drop("canonical_name"))
    _, report = dream.cycle(bad, T0)
    assert dict(report)["dedup"].startswith("error") and dict(report)["prune"] == "done"


def test_health(spark):
    g = world(spark, [("Aa", 0.5, 1), ("Bb", 0.5, 1), ("x", 0.5, 1)], [("Aa", "Bb", "uses", 0.5), ("Aa", "gone", "uses", 0.5), ("no", "gone", "uses", 0.5)])
    row = health.check(g).first()
    assert (row.status, row.orphans, row.invalid_entities) == ("degraded", 2, 1)
    g, seen = health.check_and_clean(g)
    assert seen == ["degraded", "healthy"]
    twice = g.with_(entities=g.entities.unionByName(g.entities))
    assert health.check(twice).first().status == "corrupt"


def bm25(docs, query):
    """docs: name -> tokens."""
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for p in query:
        hits = {d: sum(t.startswith(p) for t in ts) for d, ts in docs.items()}
        nq = sum(f > 0 for f in hits.values())
        idf = math.log((n - nq + 0.5) / (nq + 0.5))
        idf = idf if idf > 0 else 1e-6
        for d, f in hits.items():
            if f:
                out[d] = out.get(d, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
    return {d: round(s, 6) for d, s in out.items()}


def test_search(spark):
    rows = [("Docker Hub", 0.5, 3, {"description": "images of docker"}), ("Dock", 0.5, 9, {"description": "harbour"}), ("Été", 0.5, 1), ("foo bar", 0.5, 1, {"description": "bar foo"}), ("Zeta", 0.5, 5, {"description": "50% off"}), ("Eta", 0.5, 1)]
    e = entities(spark, rows)
    docs = {"Docker Hub": ["docker", "hub", "images", "of", "docker"], "Dock": ["dock", "harbour"], "Été": ["ete"], "foo bar": ["foo", "bar", "bar", "foo"], "Zeta": ["zeta", "50", "off"], "Eta": ["eta"]}
    q = spark.createDataFrame([(1, "dock HARB"), (2, "ete"), (3, "foo_ba"), (4, "0%"), (5, ""), (6, "bar_bar"), (7, "nothing")], "query_id int, query string")
    got = {}
    for r in search.search(e, q).collect():
        got.setdefault(r.query_id, {})[r.name] = r.score
    assert got[1] == bm25(docs, ["dock", "harb"]) and got[2] == bm25(docs, ["ete"])
    assert list(got[3]) == ["foo bar"]
    assert got[4] == {"Zeta": None}  # a wildcard in the substring fallback; "0" as a prefix matches nothing
    assert len(got[5]) == 6 and 6 not in got and 7 not in got
    assert search.search(e, q, domain="work").count() == 0
    assert search.search(e.limit(0), q).count() == 0


def test_recall_and_context(spark):
    g = world(spark, [("Docker", 0.9, 3, {"description": "d"}), ("Redis", 0.8, 2), ("Zed", 0.9, 99)], [("Docker", "Redis", "uses", 0.5), ("Zed", "Docker", "uses", 0.4)])
    m = spark.createDataFrame([(1, "What is Docker with Redis exactly?"), (2, "xyzzy plugh frobnicate?"), (3, "from docker import x, explain")], "message_id int, text string")
    got = {r.message_id: r for r in recall.recall(g, m).collect()}
    assert [e.name for e in got[1].entities][:2] == ["Docker", "Redis"]
    assert got[1].relationships == ["Docker→uses→Redis", "Zed→uses→Docker"]
    assert [e.name for e in got[2].entities] == ["Zed", "Docker", "Redis"]
    assert {r.message_id: r.block for r in recall.injected(g.entities, m).collect()} == {1: "- **Docker** (concept, general) — d\n- **Redis** (concept, general)"}
    hooked = m.withColumn("iteration", F.lit(1))
    assert recall.recall_hook(g, hooked).count() == 3 and recall.recall_hook(g, hooked, "shadow").count() == 0
    first = recall.insights(g, spark.createDataFrame([(1, "docker")], "query_id int, query string")).collect()
    assert {(r.name, r.rel_type, r.other) for r in first} == {("Docker", "uses", "Redis"), ("Docker", "uses", "Zed")}


def naive(rows):
    """Leader clustering as a plain loop."""
    from collections import Counter

    def gram(s):
        s = s.lower().strip()
        return Counter([s] if len(s) < 2 else [s[i : i + 2] for i in range(len(s) - 1)])

    def cosine(a, b):
        return sum(a[k] * b[k] for k in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    out, leads = {}, []
    for name, *_ in sorted(rows, key=lambda r: (-r[2], -r[1], r[0])):
        tests = [lambda x: name.lower() == x.lower(), lambda x: SequenceMatcher(None, name.lower(), x.lower()).ratio() >= 0.9, lambda x: cosine(gram(name), gram(x)) >= 0.9]
        hit = next((x for t in tests for x in leads if t(x)), None)
        if hit:
            out[name] = hit
        else:
            leads.append(name)
    return out


def test_fuzzy_is_exact(spark):
    import random

    rng = random.Random(5)
    base = ["kubernetes cluster", "postgres database", "abab abab abab", "Item#0000001", "xy", "x", "red anvil rod"]
    seen = set()
    while len(seen) < 220:
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "0", "7", "X"])
        if (w := "".join(s).strip()) and " ".join(w.split()) == w:
            seen.add(w)
    rows = [(n, rng.randrange(1, 10) / 10, rng.randrange(1, 4)) for n in sorted(seen)]
    got = {r.name: r.primary for r in fuzzy.leaders(entities(spark, rows)).collect()}
    assert got == naive(rows)
    g = fuzzy.merge_similar(world(spark, [("Docker", 0.2, 5), ("docker", 0.9, 1)], [("docker", "docker", "uses", 0.5)]))
    top = g.entities.first()
    assert (top.name, top.confidence, top.mention_count, top.aliases) == ("Docker", 0.2, 6, ["docker"])
    assert g.relationships.first().source_name == "Docker"


def test_fuzzy_over_serial_names(spark):
    """20,000 names of which almost all match: forming the pairs that share bigrams took longer than anyone waited."""
    import time

    rows = [(f"Customer#{i * 7919 % 100_000:09d}", 0.5, 3 - i // 10_000) for i in range(20_000)]
    began = time.perf_counter()
    got = {r.name: r.primary for r in fuzzy.leaders(entities(spark, rows)).collect()}
    assert time.perf_counter() - began < 90
    rows.sort(key=lambda r: (-r[2], -r[1], r[0]))
    first = {r[0] for r in rows[:400]}  # what comes later in rank doesn't change them
    assert {n: p for n, p in got.items() if n in first} == naive(rows[:400])
    odd = [(None, None), (None, 0.5), (2, None), (2, 0.5), (2, float("nan"))]
    left = fuzzy.leaders(entities(spark, [(f"same name {i}", c, m) for i, (m, c) in enumerate(odd)]))
    assert {r.primary for r in left.collect()} == {"same name 0"} and left.count() == 4  # nulls come first


def test_snapshot_round_trip(spark, tmp_path):
    g = world(spark, [("A", 0.5, 1, {"aliases": ["x", "ü"], "description": 'say "hi"\nnow'}), ("B", 0.5, 1)], [("A", "B", "uses", 0.25)])
    at = f"file://{tmp_path}/snap"
    row = jsonl.export_snapshot(g, at, T0, 2)
    assert row["entity_count"] == 2 and jsonl.verified(spark, at)
    none = Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids")))
    back = jsonl.import_snapshot(none, at)
    assert {r.name: (r.aliases, r.description, r.first_seen) for r in back.entities.collect()} == {"A": (["x", "ü"], 'say "hi"\nnow', T0), "B": ([], "", T0)}
    second = jsonl.export_snapshot(back.with_(entities=back.entities.withColumn("canonical_name", F.lit(None).cast("string"))), f"file://{tmp_path}/again", T0, 2)
    assert second["db_checksum"] == row["db_checksum"]
    assert jsonl.import_snapshot(g, at, "replace").entities.count() == 2
    lines = [json.dumps({"type": "x", "entity_count": 1}), json.dumps({"record_type": "entity", "entity_id": "i", "name": "One", "type": "tool", "domain": "work", "confidence": 0.5, "mention_count": 2, "first_seen": "2024-01-02T12:34:789123Z", "last_seen": "2024-01-02T12:34:56.5Z", "aliases": '["o"]'})]
    import hashlib

    head = json.loads(lines[0]) | {"checksum": hashlib.sha256("\n".join([*lines, ""]).encode()).hexdigest()}
    one = tmp_path / "one.jsonl"
    one.write_text("\n".join([json.dumps(head), *lines[1:]]) + "\n")
    row = jsonl.import_snapshot(none, f"file://{one}").entities.first()
    assert (row.name, row.aliases, row.mention_count, row.first_seen) == ("One", ["o"], 2, datetime(2024, 1, 2, 12, 34, 0, 789123))
    one.write_text(one.read_text().replace("One", "Two"))
    with pytest.raises(ValueError, match="checksum"):
        jsonl.import_snapshot(none, f"file://{one}")
    part = next(p for p in (tmp_path / "snap" / "part=1").glob("part-*") if p.stat().st_size)
    for crc in (tmp_path / "snap" / "part=1").glob(".*.crc"):
        crc.unlink()
    part.write_text(part.read_text().replace("0.5", "0.6"))
    assert not jsonl.verified(spark, at)
    with pytest.raises(ValueError, match="checksum"):
        jsonl.import_snapshot(none, at)


def test_one_file_never_passes_through_python(spark, tmp_path, monkeypatch):
    """The lines of a snapshot in one file were joined to one text in the driver, and read back as one."""
    import hashlib

    from pyspark.sql import DataFrame

    g = world(spark, [(f"näme {i}", 0.5, i) for i in range(300)], [("näme 1", "näme 2", "uses", 0.25)])
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    monkeypatch.setattr(jsonl, "bytes_verified", None)
    at = tmp_path / "all.jsonl"
    header = jsonl.export_file(g, f"file://{at}", T0, 2)
    assert (header["entity_count"], header["relationship_count"], header["memory_id_count"]) == (300, 1, 300)
    lines = at.read_text().splitlines()
    bare = {k: v for k, v in header.items() if k != "checksum"}
    assert header["checksum"] == hashlib.sha256("".join(f"{x}\n" for x in [json.dumps(bare), *lines[1:]]).encode()).hexdigest()
    assert json.loads(lines[0]) == header and [json.loads(x)["name"] for x in lines[1:301]] == sorted(f"näme {i}" for i in range(300))
    none = Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids")))
    assert jsonl.import_snapshot(none, f"file://{at}").entities.count() == 300
    with pytest.raises(ValueError, match="too many"):
        jsonl.export_file(g, f"file://{tmp_path}/more.jsonl", T0, 2, most=600)


def test_sync_files_and_stamps(spark, tmp_path):
    g = world(spark, [("A", 0.5, 1)], [("A", "B", "uses", 0.25)])
    folder = f"file://{tmp_path}"
    path = jsonl.export_sync(g, folder, "me", T0)
    mine, counts = jsonl.merge_shared(world(spark, [("A", 0.9, 7), ("C", 0.1, 1)], []), path, T0)
    assert {r.name: r.confidence for r in mine.entities.collect()} == {"A": 0.9, "C": 0.1}
    assert mine.relationships.count() == 1 and {r.record_type: r.n for r in counts.collect()} == {"entity": 1, "relationship": 1}
    assert [r.file for r in jsonl.sync_status(spark, folder).collect()] == ["me_graph.jsonl"]
    jsonl.export_backfill(g, f"{folder}/back")
    assert {json.loads(r.value)["type"] for r in spark.read.text(f"{folder}/back").collect()} == {"entity", "relationship"}
    stamps = spark.createDataFrame([("2024-01-02T12:34:789123Z",), ("2024-01-02T12:34:56.789Z",), ("bad",)], "x string").select(jsonl.read_stamp(F.col("x"))).collect()
    assert [r[0] for r in stamps] == [datetime(2024, 1, 2, 12, 34, 0, 789123), datetime(2024, 1, 2, 12, 34, 56, 789000), None]
    with pytest.raises(ValueError, match="agent"):
        jsonl.export_sync(g, folder, "../x", T0)


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.version() == 0 and s.schema_version() == 0 and s.graph().entities.count() == 0
    assert s.migrate(T0) == 2 and s.migrate(T0) == 2
    g = world(spark, [("A", 0.5, 1)], [])
    s.commit_graph(g)
    again = dream.decay(s.graph().entities, datetime(2025, 1, 1))
    s.commit(entities=again)
    assert s.table("entities").first().confidence == 0.475 and s.schema_version() == 2 and s.graph().memory_ids.count() == 1
    assert s.last_backup() is None
    s.record_backup(jsonl.export_snapshot(s.graph(), f"file://{tmp_path}/b", T0, 2))
    assert s.last_backup() == T0


def test_files(spark, tmp_path):
    (tmp_path / "kb" / "sub").mkdir(parents=True)
    (tmp_path / "kb" / "b.md").write_text("two")
    (tmp_path / "kb" / "sub" / "a b.md").write_text("one")
    (tmp_path / "kb" / "x.txt").write_text("no")
    root = f"file://{tmp_path}/kb"
    assert [r.path.rsplit("/", 1)[1] for r in files.markdown_files(spark, root).collect()] == ["b.md", "a b.md"]
    assert files.markdown_files(spark, root, 1).count() == 1
    assert {r.text for r in files.file_texts(spark, root).collect()} == {"one", "two"}
    for name, text in (("s1/messages/2.txt", "second"), ("s1/messages/10.txt", "tenth"), ("s1/3.txt", "third"), ("_archive/1.txt", "no"), (".hid/1.txt", "no"), ("s2/1.txt", "only")):
        p = tmp_path / "chat" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    chat = f"file://{tmp_path}/chat"
    assert {r.session for r in files.chat_sessions(spark, chat).collect()} == {"s1", "s2"}
    assert files.chat_sessions(spark, chat, datetime(2100, 1, 1)).count() == 0 and files.chat_sessions(spark, chat, datetime(2100, 1, 1), older=True, limit=1).count() == 1
    assert {r.session: r.text for r in files.session_texts(spark, chat).collect()}["s1"] == "second\n\ntenth\n\nthird"
    assert {r.session: r.text for r in files.session_texts(spark, chat, 1).collect()}["s1"] == "tenth\n\nthird"


def test_extraction_pipeline(spark):
    entity = lambda name, **more: {"name": name} | more
    related = lambda a, b, **more: {"source": a, "target": b} | more
    found = [entity("Docker", type="person", confidence="0.9"), entity("a@b.co", confidence=0.9), entity("Low", confidence=0.2), entity("Odd", confidence="much"), entity("docker")]
    answer = json.dumps({"entities": found, "relationships": [related("Docker", "Docker Inc.", type="likes"), related("sk-1", "Docker", type="uses"), related("", "Docker")]})
    prompts = spark.createDataFrame([("f", "s", 1, answer), ("f", "s", 2, "not json")], "source string, session_id string, seq long, text string")
    none = Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids")))
    g, report = ingest.extract_and_store(none, prompts, JsonExtractor(), T0, resolve_endpoints=True)
    assert [(r.name, r.type) for r in g.entities.collect()] == [("Docker", "technology")]
    assert [(r.source_name, r.target_name, r.rel_type) for r in g.relationships.collect()] == [("Docker", "Docker", "related_to")]
    r = report.first()
    assert (r.parse_failed, r.stored, r.rejected, r.edges) == (1, 1, 4, 1)


def test_sessions_and_backfill(spark):
    rows = [("a", i, "user", f"Docker talks with Kubernetes here, message {i}") for i in range(20)] + [("b", i, "user", "hello there") for i in range(2)] + [("c", i, "user", f"Redis number {i} is a store indeed") for i in range(4)]
    m = spark.createDataFrame(rows, stream.MESSAGE)
    states = spark.createDataFrame([("c", 2, T0, 1)], graph.SESSION)
    w = {r.session_id: r for r in ingest.session_windows(m, states).collect()}
    assert set(w) == {"a"} and w["a"].msg_index == 20 and len(w["a"].text.split("\n")) == 15
    none = Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids")))
    g, states, _ = ingest.ingest_sessions(none, states, m, RuleExtractor(), T0)
    assert {r.name for r in g.entities.collect()} == {"Docker", "Kubernetes"}
    assert {r.session_id: (r.last_extracted_msg_index, r.total_extractions) for r in states.collect()} == {"a": (20, 1), "c": (2, 1)}
    docs = [("kb", "1", "Docker uses Kubernetes in this text of fifty characters."), ("kb", "2", "short"), ("kb", "3", "nothing to be found in here, all of it in lower case"), ("kb", "4", "word " * 80_000), ("kb", "5", None)]
    f = spark.createDataFrame(docs, "source string, file_path string, text string")
    g, done = ingest.backfill(none, graph.empty(spark, "checkpoint"), f, RuleExtractor(), T0)
    assert {r.file_path: (r.status, r.entities_extracted) for r in done.collect()} == {"1": ("processed", 2), "2": ("processed", 0), "3": ("failed", 0), "4": ("failed", 0), "5": ("processed", 0)}
    assert {r.file_path for r in merge.unprocessed(f, done).collect()} == {"3", "4"}


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(6):  # one message a file: the state must buffer
        (source / f"{k}.json").write_text(json.dumps({"session_id": "s", "idx": k, "role": "user", "text": f"a message of some length, number {k}"}) + "\n")
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files come in order of these
    got = []
    q = stream.ingest(stream.read_messages(spark, str(source), 1), lambda df, _: got.extend(df.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert [r.msg_index for r in got] == [3, 6] and got[1].text.startswith("user: a message of some length, number 3")


def test_breaker_and_triggers():
    now = [0.0]
    b = stream.Breaker(3, 300, lambda: now[0])
    fail = lambda: 1 / 0
    assert [b.call(fail) for _ in range(4)] == ["failed"] * 3 + ["open"]
    now[0] = 301
    assert b.call(lambda: None) == "done"
    assert [stream.every(50)(i) for i in (0, 49, 50, 100)] == [False, False, True, True] and not stream.every(0)(50)
    held, due = stream.window_step([], [(0, "x" * 30), (1, "y" * 30)])
    assert due is None and stream.window_step(held, [(1, "y" * 30), (2, "z")])[1][0] == 3


def test_late_messages_and_failing_stores_lose_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for at, k in enumerate((0, 1, 3, 2, 4, 5, 1)):  # 2 comes late, 1 again
        (source / f"{at}.json").write_text(json.dumps({"session_id": "s", "idx": k, "role": "user", "text": f"a message of some length, number {k}"}) + "\n")
        os.utime(source / f"{at}.json", (1_700_000_000 + at, 1_700_000_000 + at))
    got, calls = {}, []

    def store(df, batch_id):
        rows = df.collect()
        if rows:
            calls.append(batch_id)
            if len(calls) == 1:
                raise RuntimeError("no store")
        got[batch_id] = rows

    def run():
        q = stream.ingest(stream.read_messages(spark, str(source), 1), store, str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:  # noqa: BLE001
            return False
        return True

    assert not run() and run()  # the batch that failed is handed over again
    texts = [r.text for b in sorted(got) for r in got[b]]
    assert [sorted(int(line[-1]) for line in t.split("\n")) for t in texts] == [[0, 1, 3], [2, 4, 5]] and calls[0] == calls[1]
    dead = []
    q = stream.ingest(stream.read_messages(spark, str(source), 1), lambda df, _: 1 / 0, str(tmp_path / "cp2"), stream.Breaker(1), dead_letter=lambda df, _: dead.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and [r.text for r in dead] == texts


def test_import_order_is_that_of_files_and_lines(spark, tmp_path):
    """Later lines win, whatever the sizes of the files: Spark reads the largest first."""
    e = lambda name, c: json.dumps({"record_type": "entity", "entity_id": f"id-{name}", "name": name, "type": "tool", "domain": "work", "confidence": c, "mention_count": 1})
    at = tmp_path / "x.jsonl"
    at.mkdir()
    (at / "part-0.txt").write_text(e("a", 0.1) + "\n")
    (at / "part-1.txt").write_text("".join(e("a", 0.2) + "\n" for _ in range(400)) + e("a", 0.3) + "\n")
    (at / "part-2.txt").write_text(e("a", 0.4) + "\n" + e("a", 0.5) + "\n")
    g = world(spark, [], [])
    out, _ = jsonl.merge_shared(g, f"file://{at}", T0)
    assert [(r.name, r.confidence) for r in out.entities.collect()] == [("a", 0.1)]
    lines = jsonl._lines(spark, f"file://{at}")
    assert [r.value for r in lines.orderBy("seq").collect()] == [x for p in sorted(at.iterdir()) for x in p.read_text().splitlines()]


def test_extractors_are_asked_again():
    waits, calls = [], []

    def flaky(prompts):
        calls.append(list(prompts))
        if "bad" in prompts or len(calls) == 1:
            raise RuntimeError("busy")
        return [p.upper() for p in prompts]

    ask = Retried(flaky, times=2, wait=1.0, sleep=waits.append)
    assert ask(["a", "b"]) == ["A", "B"] and waits == [1.0]
    assert ask(["a", "bad", "b"]) == ["A", "", "B"]


def test_store_keeps_what_does_not_change(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    g = world(spark, [("A", 0.5, 2)], [])
    s.commit_graph(g)
    s.migrate(T0)
    assert sorted(p.name for p in (tmp_path / "s" / "v=2").iterdir()) == ["schema_meta"]
    assert s.table("entities").count() == 1 and s.index().n == 1 and s.version() == 2
    s.commit(entities=s.table("entities").limit(0))
    s.vacuum()
    assert s.table("entities").count() == 0 and s.table("postings").count() == 1 and not (tmp_path / "s" / "v=1" / "entities").exists()


def test_tasks_do_not_grow_with_tables(spark):
    """Tables in the shared folder are written in files of bounded rows, by tasks of bounded bytes; settings stay as they were."""
    had = {k: spark.conf.get(k, None) for k in components.SMALL}
    n = components.FILE_ROWS * 2 + 1
    t = components.shared_table(spark.range(0, n, numPartitions=1).selectExpr("id % 7 AS a", "id"))
    assert len(t.inputFiles()) == 3 and t.count() == n
    assert had == {k: spark.conf.get(k, None) for k in components.SMALL}
    assert components.spread(t, 10 * components.TASK_ROWS, "a").rdd.getNumPartitions() == 10


def test_neighbourhood_of_names_with_many_edges(spark, monkeypatch):
    """A name's edges in slices give the same first edges, for few names and for many."""
    g = edges(spark, [(f"s{i % 97}", f"t{i % 5}", f"r{i % 3}", (i * 31 % 11) / 10) for i in range(3000)]).dropDuplicates(["source_name", "target_name", "rel_type"])
    g = components.shared_table(g.unionByName(edges(spark, [("loop", "loop", "uses", 0.5), ("loop", "t1", "uses", 0.5)])))
    names_ = spark.createDataFrame([(f"s{i}",) for i in range(0, 97, 3)] + [("t1",), ("t4",), ("loop",), ("none",), ("t1",)], "name string")
    rows = lambda: sorted(map(tuple, graph.neighbourhood(names_, g, 5).collect()))
    whole = rows()
    slices = []
    monkeypatch.setattr(components, "TASK_ROWS", 200)
    monkeypatch.setattr(components, "spread", lambda df, n, *keys, real=components.spread: slices.append(df.select(*keys).distinct().where("name = 't1'").count()) or real(df, n, *keys))
    assert rows() == whole
    monkeypatch.setattr(graph, "FEW", 1)
    assert rows() == whole and slices[0] > 1 and slices[2] > 1


def test_messages_of_the_same_words_are_answered_once(spark, monkeypatch):
    """Messages that repeat were joined with entities and edges one by one."""
    g = world(spark, [("Docker Engine", 0.9, 5), ("Redis", 0.8, 3), ("Top", 0.9, 9)], [("Docker Engine", "Redis", "uses", 0.5)])
    asked = []
    monkeypatch.setattr(recall, "_found", lambda e, worded, *more, real=recall._found: asked.append(worded.count()) or real(e, worded, *more))
    texts_ = ["What is the docker?", "about redis", "What is the docker?", "zzz", None]
    rows = [(i, texts_[i % 5], 0) for i in range(50)] + [(0, "about redis", 0)]  # one message in two texts
    got = {r.message_id: r.entities for r in recall.recall(g, spark.createDataFrame(rows, "message_id int, text string, iteration int")).collect()}
    named = {i: [x.name for x in e] for i, e in got.items()}
    assert asked == [5] and len(named) == 50
    assert named[0] == ["Docker Engine", "Redis"] and named[1] == ["Redis"] and named[2] == ["Docker Engine"] and named[3] == named[4] and named[3][0] == "Top"


def test_bigrams_are_counted_in_their_row(spark):
    """Bigrams of all names were gathered in one hash table; names that repeat still add up."""
    got = {(r.name, r.gram): r.n for r in fuzzy.gram_counts(entities(spark, [("abab", 0.5, 1), ("x", 0.5, 1)]).unionByName(entities(spark, [("abab", 0.5, 1)]))).collect()}
    assert got == {("abab", "ab"): 4, ("abab", "ba"): 2, ("x", "x"): 1}


def test_nearest_holds_few_cosines_at_once(spark, monkeypatch):
    """All queries of a block were held against all rows of a batch, in several copies."""
    import numpy as np

    rng, sizes = np.random.default_rng(1), []
    v = rng.normal(size=(600, 4)).round(1).tolist()
    monkeypatch.setattr(search, "ROWS", 64)
    monkeypatch.setattr(search, "CELLS", 64 * 7)
    monkeypatch.setattr(search.np, "partition", lambda a, *x, real=np.partition, **k: sizes.append(a.size) or real(a, *x, **k))
    sent = type("Sent", (), {"value": ([*range(30)], [np.array(x) for x in v[:30]])})
    import pandas as pd

    got = pd.concat([*search._nearest(sent, 5, "vec_id")([pd.DataFrame({"id": range(600), "v": [np.array(x) for x in v]})])])
    m = np.array(v)
    for q in range(30):
        cosine = np.round(m @ m[q] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[q]), 6)
        assert [*got[got.query_id == q].vec_id] == sorted(range(600), key=lambda i: (-cosine[i], i))[:5]
    assert max(sizes) <= 64 * 7


def test_walk_of_tangled_rows_streams(spark):
    """Tangled rows were handed to pandas group by group; a task walks many groups, whatever the batches."""
    import random

    rng = random.Random(3)
    rows = [(f"n{g}-{rng.randrange(6)}", f"i{g}-{rng.randrange(6)}", i) for i, g in enumerate(rng.randrange(60) for _ in range(900))]
    df = entities(spark, [(n, 0.5, 1, {"entity_id": e}) for n, e, _ in rows[:1]]).limit(0)
    incoming = entities(spark, [(n, 0.5, i, {"entity_id": e}) for n, e, i in rows]).withColumn("seq", F.col("mention_count"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.name, r.entity_id, r.mention_count) for r in merge.sync_first_wins(df, incoming).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names_, ids, want = set(), set(), set()
    for n, e, i in rows:
        if n not in names_ and e not in ids:
            want.add((n, e, i))
            names_.add(n)
            ids.add(e)
    assert got == want


def test_large_folders_are_compressed(spark, tmp_path, monkeypatch):
    """Snapshots and sync files of many lines were written as plain text; they read back the same."""
    monkeypatch.setattr(jsonl, "PLAIN", 10)
    g = world(spark, [(f"näme {i}", 0.5, i) for i in range(50)], [("näme 1", "näme 2", "uses", 0.25)])
    none = Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids")))
    at = f"file://{tmp_path}/snap"
    jsonl.export_snapshot(g, at, T0, 2)
    assert [*(tmp_path / "snap" / "part=1").glob("part-*.gz")] and not [*(tmp_path / "snap" / "part=2").glob("part-*.gz")]
    assert jsonl.verified(spark, at) and jsonl.import_snapshot(none, at).entities.count() == 50
    path = jsonl.export_sync(g, f"file://{tmp_path}/sync", "me", T0)
    assert all(p.name.endswith(".gz") for p in (tmp_path / "sync" / "me_graph.jsonl").glob("part-*"))
    assert jsonl.merge_shared(none, path, T0)[0].entities.count() == 50
    assert [(r.file, r.bytes > 0) for r in jsonl.sync_status(spark, f"file://{tmp_path}/sync").collect()] == [("me_graph.jsonl", True)]


def test_answers_are_parsed_once(spark, monkeypatch):
    """Each use of an answer parsed it again; a plain object now skips the repair, with the same result."""
    from weft.functions import texts

    raw = ['{"entities": []}', ' {"entities": []}\n', '```json\n{"entities": []}\n```', "{bad}", "{}", "json {}", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")
    got = {r.i: (r.u, r.ok) for r in df.select("i", texts.unfenced(F.col("raw")).alias("u"), texts.parsed(F.col("raw")).isNotNull().alias("ok")).collect()}
    assert [got[i] for i in range(8)] == [('{"entities": []}', True)] * 3 + [("{bad}", False), ("{}", True), ("{}", True), (None, False), ("", False)]
    calls = []
    monkeypatch.setattr(texts, "parsed", lambda c, real=texts.parsed: calls.append(1) or real(c))
    g = Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids")))
    prompts = spark.createDataFrame([("s", "Docker Engine. Redis Cache")], "source string, text string").select("source", F.lit(None).cast("string").alias("session_id"), F.lit(1).cast("long").alias("seq"), "text")
    out, report = ingest.extract_and_store(g, prompts, RuleExtractor(), T0)
    assert out.entities.count() == 4 and report.first().edges == 2 and len(calls) == 1
