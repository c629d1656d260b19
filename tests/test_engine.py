"""Log, folds, read models, audit, queues, sagas, functions, runner, cache."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logweir.functions import crypto, evolution, text
from logweir.operators import audit, fold, readmodel, saga, workqueue
from logweir.plans import command
from logweir.plans.query import CachePolicy, CachingBus, QueryBus
from logweir.sources import event_log as log
from logweir.sources import schema
from logweir.streaming import runner


def meta(n):
    return {"event_id": f"e{n}", "command_id": "c", "correlation_id": "r", "timestamp": datetime(2024, 1, 1) + timedelta(seconds=n), "baggage": {}}


def test_append_checks_the_version_and_keeps_offsets_dense(spark, tmp_path):
    store = log.StoredLog(spark, str(tmp_path / "log"))
    e = lambda n: {"event_type": "ItemAdded", "payload": {"sku": n}, "metadata": meta(n)}
    assert store.append("cart:1", [e(1), e(2)], 0) == [1, 2]
    for stale in (0, 1, 3):
        with pytest.raises(log.StaleVersion):
            store.append("cart:1", [e(3)], stale)
    assert store.append("cart:1", [], 99) == []
    assert store.append("cart:2", [e(4)], 0) == [3]
    assert store.append("cart:1", [e(5)], 2) == [4]
    assert [(r["global_offset"], r["aggregate_id"], r["version"]) for r in store.events().orderBy("global_offset").collect()] == [(1, "1", 1), (2, "1", 2), (3, "2", 1), (4, "1", 3)]
    assert store.append_once("cart:3", [e(6)], 0, "k", "Add") == ([5], 1, False)
    assert store.append_once("cart:3", [e(6)], 7, "k", "Add") == ([5], 1, True)
    with pytest.raises(log.KeyBound):
        store.append_once("cart:4", [e(6)], 0, "k", "Add")
    import shutil

    shutil.rmtree(f"{store.path}/inbox")  # as if cut off between the events and their inbox row
    assert store.append_once("cart:3", [e(6)], 0, "k", "Add") == ([5], 1, True) and store.inbox().count() == 1
    with pytest.raises(ValueError):
        store.append("cart:9", [{"event_type": "x", "payload": "\0"}], 0)


def test_recorded_streams_round_trip(spark, tmp_path):
    store = log.StoredLog(spark, str(tmp_path / "log"))
    store.append("order:a:b", [{"event_type": "OrderPlaced", "payload": {"orderId": "o", "quantity": 2}, "metadata": meta(1)}], 0)
    (tmp_path / "f.json").write_text(log.fixture_text(store.events().collect()))
    row = log.read_fixture(spark, str(tmp_path / "f.json")).first()
    assert (row["global_offset"], row["aggregate_type"], row["aggregate_id"], row["version"], row["metadata"]["event_id"]) == (1, "order", "a:b", 1, "e1")
    assert json.loads(row["payload"]) == {"orderId": "o", "quantity": 2}


def test_names():
    assert schema.parse_stream("cart:a:b") == ("cart", "a:b")
    for bad in ("Cart:1", "cart", "cart:", "9a:1"):
        with pytest.raises(ValueError):
            schema.parse_stream(bad)
    assert schema.projection_table("open_orders") == "open_orders_view"
    with pytest.raises(ValueError):
        schema.projection_table("Bad-Name")
    assert schema.snake_name("OpenOrdersProjection") == "open_orders" and schema.snake_name("HTTPLog") == "http_log"


def test_three_folds_agree(spark):
    rows = [("cart", str(i % 5), i // 5 + 1, "add" if i % 3 else "clear") for i in range(60)]
    events = spark.createDataFrame(rows, "aggregate_type string, aggregate_id string, version long, event_type string")
    start = F.lit(0).cast("long")
    a = fold.fold_reduce(events, ("event_type",), start, lambda s, e: F.when(e["event_type"] == "clear", F.lit(0).cast("long")).otherwise(s + 1))
    b = fold.fold_python(events, lambda s, e: {"n": 0 if e["event_type"] == "clear" else s["n"] + 1}, lambda: {"n": 0}, "aggregate_type string, aggregate_id string, n long")
    assert sorted((r["aggregate_id"], r["state"]) for r in a.collect()) == sorted((r["aggregate_id"], r["n"]) for r in b.collect())
    c = fold.fold_columns(events, {"n": F.count("*")}).collect()
    assert {r["n"] for r in c} == {12}


def test_load_from_snapshots(spark):
    events = spark.createDataFrame([("a", "1", v, "x") for v in range(1, 8)], "aggregate_type string, aggregate_id string, version long, event_type string")
    snaps = spark.createDataFrame([("a", "1", 5, 2)], "aggregate_type string, aggregate_id string, version long, schema int")
    at = lambda **k: sorted(r["version"] for r in fold.load(events, snaps, **k).collect())
    assert at() == [6, 7] and at(expected=-1) == list(range(1, 8)) and at(expected=2) == [6, 7] and at(expected=3) == list(range(1, 8)) and at(expected=3, reachable=(2,)) == [6, 7]


def test_canonical_text(spark):
    for value, want in ((42, "42"), (Decimal("19.90"), "19.90"), (1.2345678e7, "12345678"), (1.0e-4, "0.00010"), (-0.0, "0.0"), (timedelta(seconds=90), "90.000000000"), (True, "true"), ("B", "B"), (None, None)):
        if value not in (1.2345678e7, 1.0e-4):
            assert text.value_text(value) == want
    assert text.value_text(Decimal("1.2345678E7")) == "12345678" and text.value_text(Decimal("1.0E-4")) == "0.00010"
    df = spark.createDataFrame([('{"a": 19.90, "b": 1.2345678E7, "c": 1.0E-4, "d": -0.0, "e": true, "f": null, "g": "x"}',)], "data string")
    got = df.select(*(text.json_field_text("data", F.lit(k)).alias(k) for k in "abcdefgh")).first()
    assert list(got) == ["19.90", "12345678", "0.00010", "0.0", "true", None, "x", None]


def view(spark):
    rows = [("1", "B", 10, 0), ("2", "a", 9, 1), ("3", None, None, 0), ("4", "a", 10, 2), ("5", "é", 2, 0)]
    return spark.createDataFrame(rows, "id string, name string, rank int, version long")


def test_pages(spark):
    v = view(spark)
    ids = lambda **k: [r["id"] for r in readmodel.page_rows(v, readmodel.PageRequest(**k)).collect()]
    assert ids(size=10) == ["1", "2", "3", "4", "5"]
    assert ids(sort=(("name", True),)) == ["1", "2", "4", "5", "3"]
    assert ids(sort=(("name", False),)) == ["3", "5", "2", "4", "1"]
    assert ids(sort=(("rank", True),)) == ["1", "4", "5", "2", "3"]
    assert ids(sort=(("version", False), ("id", False))) == ["4", "2", "5", "3", "1"]
    assert ids(sort=(("absent", True),)) == ["1", "2", "3", "4", "5"]
    p = readmodel.find_page(v, readmodel.PageRequest(0, 1), "name", "a")
    assert (p.total, p.total_pages, p.has_next, p.has_previous, [r["id"] for r in p.content.collect()]) == (2, 2, True, False, ["2"])
    assert readmodel.find_page(v, readmodel.PageRequest(9, 5)).total == 5 and readmodel.find_page(v, readmodel.PageRequest(9, 5)).content.count() == 0
    assert readmodel.find_page(v, readmodel.PageRequest(), "name", None).total == 0
    assert readmodel.find_page(v, readmodel.PageRequest(), "rank", 10).total == 2
    for bad in ("id", "version", "no-field"):
        with pytest.raises(ValueError):
            readmodel.matches(v, bad, "x")
    for bad in ({"size": 0}, {"size": 1001}, {"page": -1}, {"sort": (("a", True), ("a", False))}):
        with pytest.raises(ValueError):
            readmodel.PageRequest(**bad)
    secret = v.withMetadata("name", {"encrypted": True})
    with pytest.raises(ValueError):
        readmodel.matches(secret, "name", "a")
    with pytest.raises(ValueError):
        readmodel.page_rows(secret, readmodel.PageRequest(sort=(("name", True),)))


def test_writes_of_a_view(spark):
    w = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 3, "z", False), ("b", 4, None, True), ("c", 5, "p", True), ("c", 6, "q", False)], "id string, global_offset long, v string, deleted boolean")
    assert sorted((r["id"], r["v"], r["version"]) for r in readmodel.upserts(w).collect()) == [("a", "y", 1), ("c", "q", 0)]
    v = view(spark).select("id", "name", "version")
    asked = spark.createDataFrame([("2", "n", 1), ("4", "m", 1), ("9", "k", 0)], "id string, name string, expected long")
    after, refused = readmodel.compare_and_set(v, asked)
    assert {r["id"]: (r["name"], r["version"]) for r in after.collect()}["2"] == ("n", 2)
    assert sorted(r["id"] for r in refused.collect()) == ["4", "9"]
    assert readmodel.deleted(v, asked.select("id")).count() == 3


def test_closure_ends_on_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "z"), ("z", "x"), ("y", "x")]
    e = spark.createDataFrame(rows, "event_id string, causation_id string")
    got = lambda root: sorted(r["event_id"] for r in audit.causation_closure(e, root).collect())
    assert got("a") == ["a", "b", "c", "d"] and got("c") == ["c"] and got("none") == [] and got("x") == ["x", "y", "z"]


def outbox(spark, rows):
    return spark.createDataFrame([(s, f"e{s}", "t", a, st, 0, None, None) for s, a, st in rows], "seq long, entry_id string, aggregate_type string, aggregate_id string, status string, attempts long, next_retry_at timestamp_ntz, claimed_by string")


def test_claims(spark):
    box = outbox(spark, [(1, "a", "FAILED"), (2, "a", "PENDING"), (3, "b", "IN_PROGRESS"), (4, "b", "PENDING"), (5, None, "PENDING"), (6, None, "FAILED"), (7, "c", "PENDING"), (8, "c", "PENDING")])
    seqs = lambda mode: [r["seq"] for r in workqueue.claimable(box, "2024-01-01 00:00:00", 10, mode).collect()]
    assert seqs(workqueue.AVAILABILITY_FIRST) == [2, 5, 7] and seqs(workqueue.STRICT_PER_AGGREGATE) == [5, 7]
    later = box.withColumn("next_retry_at", F.when(F.col("seq") == 7, F.lit("2025-01-01").cast("timestamp_ntz")))
    assert [r["seq"] for r in workqueue.claimable(later, "2024-01-01 00:00:00", 10).collect()] == [2, 5]
    held = workqueue.claimed(box, workqueue.claimable(box, "2024-01-01 00:00:00", 10), "me")
    state = {r["seq"]: (r["status"], r["claimed_by"]) for r in held.collect()}
    assert state[2] == state[5] == state[7] == ("IN_PROGRESS", "me") and state[8][0] == "PENDING"
    ask = spark.createDataFrame([(2,), (3,), (1,)], "seq long")
    done = {r["seq"]: r["status"] for r in workqueue.transition(held, ask, "deliver", "me").collect()}
    assert done[2] == "DELIVERED" and done[3] == "IN_PROGRESS" and done[1] == "FAILED"
    assert {r["seq"]: r["status"] for r in workqueue.transition(held, ask, "skip").collect()}[1] == "SKIPPED"


def test_timeouts_take_turns(spark):
    old = datetime(2020, 1, 1)
    rows = [(f"f{i}", "RUNNING", old + timedelta(days=i), old) for i in range(5)] + [("c0", "COMPENSATING", old, old)]
    s = spark.createDataFrame(rows, "saga_id string, status string, created_at timestamp, updated_at timestamp").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})
    assert [r["saga_id"] for r in workqueue.timed_out(s, "2024-01-01 00:00:00", 1, 3).collect()] == ["f0", "c0", "f1"]


def test_overdue_sagas_are_all_given_and_not_by_one_task(spark):
    """A limit on them left out rows beyond a million, and ordered all of them in one task."""
    from logweir.plans import catalog

    plan = catalog.QUERIES["saga_timed_out_bounds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Limit", "Sort", "Window"))
    old, bound = datetime(2020, 1, 1), datetime(2023, 12, 31)
    rows = [("f", "STARTED", old, bound), ("g", "RUNNING", bound, old), ("c", "COMPENSATING", bound, old), ("d", "COMPENSATING", old, bound), ("e", "COMPLETED", old, old), ("n", None, old, old)]
    s = spark.createDataFrame(rows, "saga_id string, status string, created_at timestamp, updated_at timestamp").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})
    assert sorted((r["saga_id"], r["population"]) for r in workqueue.overdue(s, "2024-01-01 00:00:00", 1).collect()) == [("c", 1), ("f", 0)]


def test_dead_ranges_merge(spark):
    kind = "projection string, from_offset long, to_offset long, attempts int"
    old, new = spark.createDataFrame([("p", 1, 5, 3)], kind), spark.createDataFrame([("p", 1, 5, 1), ("p", 6, 9, 1)], kind)
    assert sorted((r["from_offset"], r["attempts"]) for r in workqueue.merge_dead_ranges(old, new).collect()) == [(1, 4), (6, 1)]


def test_saga_rows(spark):
    kind = "saga_id string, status string, version long, last_applied_offset long, pre_fault_status string, saga_type string"
    s = spark.createDataFrame([("a", "RUNNING", 3, None, None, "t"), ("b", "COMPLETED", 1, 4, None, "t"), ("c", "RUNNING", 2, 9, None, "t")], kind)
    steps = spark.createDataFrame([("a", 3, "COMPLETED", 7), ("b", 1, "RUNNING", 8), ("c", 1, "RUNNING", 10)], "saga_id string, version long, status string, offset long")
    got = {r["saga_id"]: (r["status"], r["version"], r["last_applied_offset"]) for r in saga.apply_steps(s, steps).collect()}
    assert got == {"a": ("COMPLETED", 4, 7), "b": ("COMPLETED", 1, 4), "c": ("RUNNING", 2, 9)}
    once = saga.mark_faulted(s, s.withColumn("version", F.when(F.col("saga_id") == "c", 9).otherwise(F.col("version"))))
    f = {r["saga_id"]: (r["status"], r["pre_fault_status"], r["version"]) for r in once.collect()}
    assert f == {"a": ("FAULTED", "RUNNING", 4), "b": ("COMPLETED", None, 1), "c": ("RUNNING", None, 2)}
    again = {r["saga_id"]: (r["pre_fault_status"], r["version"]) for r in saga.mark_faulted(once, once).collect()}
    assert again["a"] == ("RUNNING", 5)


def test_upcasting(spark):
    chain = evolution.Chain().add("A", 1, evolution.renamed("k", "key")).add("A", 2, evolution.added("unit", "kg"))
    rows = spark.createDataFrame([("A", '{"k": "1"}', 1), ("A", '{"key": "2"}', 2), ("A", '{"key": "3", "unit": "g"}', 3), ("B", "{}", 1)], "event_type string, payload string, schema_version int")
    got = [(json.loads(r["payload"]), r["schema_version"]) for r in chain.apply(rows).collect()]
    assert got == [({"key": "1", "unit": "kg"}, 3), ({"key": "2", "unit": "kg"}, 3), ({"key": "3", "unit": "g"}, 3), ({}, 1)]
    with pytest.raises(Exception, match="schema ahead"):
        chain.apply(spark.createDataFrame([("A", "{}", 4)], "event_type string, payload string, schema_version int")).collect()
    assert chain.can_reach("A", 1, 3) and not evolution.Chain().add("A", 2, evolution.dropped("x")).can_reach("A", 1, 3)


def test_a_wrong_key_is_an_error_and_a_deleted_one_redacts(spark):
    keys = spark.createDataFrame([(s,) for s in "ab"], "s string").select(text.subject_hash(F.col("s")).alias("subject_hash"), F.lit(b"0123456789abcdef").alias("key"))
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", None)], "subject string, email string")
    secret = crypto.encrypted(rows, ["email"], "subject", keys)
    assert "x" not in {r["email"] for r in secret.collect()}
    left = crypto.forgotten(keys, spark.createDataFrame([("a",)], "subject string"))
    assert sorted(str(r["email"]) for r in crypto.decrypted(secret, ["email"], "subject", left).collect()) == ["None", "[REDACTED]", "y"]
    with pytest.raises(Exception):
        crypto.decrypted(secret, ["email"], "subject", keys.withColumn("key", F.lit(b"fedcba9876543210"))).collect()
    assert crypto.export("a", {"mail": rows.where("subject = 'a'"), "none": None}).collect()[0]["section"] == "mail"


def test_runner(spark, tmp_path):
    events = spark.range(1, 11).select(F.col("id").alias("global_offset"))
    seen, fail = [], {}

    def update(rows):
        got = [r[0] for r in rows.collect()]
        for n in got:
            if fail.get(n, 0) > 0:
                fail[n] -= 1
                raise (ValueError if n % 2 else OSError)("no")
        seen.extend(got)

    waits = []
    r = runner.Runner(spark, lambda: events, str(tmp_path), most_failures=3, wait=waits.append)
    assert r.catch_up(runner.Projection("p", update, batch=4)) == 3 and seen == list(range(1, 11))
    assert not r.advance("p", 5) and r.lag("p") == (0, False)
    r.reset("p")
    assert r.lag("p", 10) == (10, True)
    seen.clear()
    fail.update({2: 2})
    r.catch_up(runner.Projection("p", update, runner.HALT, 5))
    assert seen == list(range(1, 11)) and waits == [1.0, 2.0]
    fail.update({3: 9})
    with pytest.raises(ValueError):
        r.reset("p")
        r.catch_up(runner.Projection("p", update, runner.HALT, 5))
    seen.clear()
    r.catch_up(runner.Projection("p", update, runner.DEAD_LETTER, 5))
    assert seen == [6, 7, 8, 9, 10] and r.position("p")["dead"][0]["from_offset"] == 1
    assert r.replay(runner.Projection("p", update)) == {"done": 0, "failed": 1} and r.position("p")["dead"][0]["attempts"] == 2
    fail.clear()
    assert r.replay(runner.Projection("p", update)) == {"done": 1, "failed": 0} and r.position("p")["dead"] == []
    fail.update({7: 9})
    r.reset("p")
    seen.clear()
    r.catch_up(runner.Projection("p", update, runner.SKIP, 5))
    assert seen == [1, 2, 3, 4, 5]
    assert runner.classify(RuntimeError()) == runner.TRANSIENT and runner.classify(KeyError()) == runner.POISON


def test_what_cannot_be_read_halts_and_an_outage_is_waited_for(spark, tmp_path):
    events = spark.range(1, 6).select(F.col("id").alias("global_offset"), F.create_map(F.lit("a"), F.lit("b")).alias("m"))
    bad = events.withColumn("payload", F.when(F.col("global_offset") == 4, F.raise_error(F.lit("no type of this name"))).otherwise(F.lit("x")))
    waits, seen, outages = [], [], [OSError(), OSError(), OSError()]

    def log():
        if outages:
            raise outages.pop()
        return bad

    r = runner.Runner(spark, log, str(tmp_path), most_poisoned_reads=2, wait=waits.append)
    with pytest.raises(runner.ReadPoison, match="after offset 3"):
        r.catch_up(runner.Projection("p", lambda rows: seen.extend(x[0] for x in rows.collect()), runner.SKIP, 3))
    assert seen == [1, 2, 3] and waits == [1.0, 2.0, 4.0, 1.0] and r.position("p")["offset"] == 3 and r.position("p")["dead"] == []
    assert runner.unreadable(ValueError()) and not runner.unreadable(OSError()) and not runner.unreadable(ValueError("schema ahead: A 4"))


def test_commands_and_their_interceptors(spark):
    class Open(str):
        pass

    class Close(str):
        pass

    calls = []

    class Traced(command.Interceptor):
        def __init__(self, name, stop=(), fail=()):
            self.name, self.stop, self.fail = name, stop, fail

        def before(self, context):
            calls.append(f"{self.name}<")
            if context.command_type in self.fail:
                raise ValueError("before")
            return context.command_type not in self.stop

        def after(self, context):
            calls.append(f"{self.name}>")
            raise RuntimeError("logged only")

        def on_error(self, context, error):
            calls.append(f"{self.name}!")

    second, rows = Traced("b", stop=("Close",)), command.Audit(lambda: "u")
    bus = command.CommandBus([rows, Traced("a"), second])
    bus.register(Open, "door", str, lambda c: (c + "ed",) if c != "bad" else 1 / 0)
    bus.register(Close, "door", str, lambda c: ("never",))
    with pytest.raises(ValueError, match="has a handler"):
        bus.register(Open, "door", str, tuple)
    assert bus.execute(Open("x")).events == ("xed",) and calls == ["a<", "b<", "b>", "a>"]
    calls.clear()
    assert bus.execute(Close("x")) == command.Result((), command.VETOED, "Traced") and calls == ["a<", "b<", "a>"]
    calls.clear()
    with pytest.raises(ZeroDivisionError):
        bus.execute(Open("bad"))
    assert calls == ["a<", "b<", "b!", "a!"]
    calls.clear()
    second.fail = ("Open",)
    with pytest.raises(ValueError, match="before"):
        bus.execute(Open("x"))
    assert calls == ["a<", "b<", "a!"]
    second.fail = ()
    assert bus.execute(Open("k"), "key").reason is None and bus.execute(Open("k"), "key") == command.Result(("ked",), command.REPLAY)
    with pytest.raises(ValueError, match="another command"):
        bus.execute(Open("other"), "key")
    with pytest.raises(ValueError, match="no handler"):
        bus.execute("x")
    got = audit.command_rows(spark.createDataFrame(rows.rows, command.Audit.OUTCOMES)).collect()
    assert [(r["outcome"], r["event_count"]) for r in got] == [("SUCCESS", 1), ("VETOED", 0), ("FAILURE", 0), ("FAILURE", 0), ("SUCCESS", 1), ("SUCCESS", 1), ("FAILURE", 0)]


def test_migrations_of_snapshots(spark):
    chain = evolution.Migrations().add(1, 3, evolution.added("a", "1")).add(3, 4, evolution.added("b", "2")).add(2, 5, evolution.added("c", "3"))
    assert chain.reachable(4) == (1, 3) and chain.reachable(5) == (2,) and chain.path(4, 4) == [] and chain.path(5, 4) is None
    rows = spark.createDataFrame([(i, "{}" if i != 9 else None) for i in (1, 2, 3, 4, 5)] + [(1, None)], "schema int, state string")
    got = sorted((r["schema"], str(r["state"] and json.loads(r["state"]))) for r in chain.apply(rows, 4).collect())
    assert got == [(4, "None"), (4, "{'a': '1', 'b': '2'}"), (4, "{'b': '2'}"), (4, "{}")]
    with pytest.raises(Exception, match="gave no state"):
        evolution.Migrations().add(1, 2, lambda s: F.lit(None).cast("string")).apply(rows, 2).collect()
    with pytest.raises(ValueError):
        chain.add(6, 6, evolution.dropped("x"))


def test_jitter_stays_in_its_bounds(spark):
    waits = spark.range(1, 9).select(*(f(F.col("id"), jitter=F.lit(j)).alias(f"{f.__name__}{i}") for f in (text.backoff_ms, text.poll_backoff_ms) for i, j in enumerate((0.0, 0.5, 0.999999))))
    first, last = waits.first(), waits.collect()[-1]
    assert first["backoff_ms0"] == 25 and first["backoff_ms1"] == 50 and 74.9 < first["backoff_ms2"] < 75
    assert (last["poll_backoff_ms0"], last["poll_backoff_ms2"]) == (30_000, 60_000) and 500 <= first["poll_backoff_ms1"] <= 1000


def test_cache():
    class Q(tuple):
        pass

    calls, now = [], [0.0]
    bus = QueryBus()
    bus.register(Q, lambda q: calls.append(q) or len(calls))
    cached = CachingBus(bus, {Q: CachePolicy(10, 2, frozenset({"Changed"}), per_user=True)}, clock=lambda: now[0])
    assert cached.dispatch(Q((1,)), "u") == cached.dispatch(Q((1,)), "u") == 1
    assert cached.dispatch(Q((1,)), "v") == 2 and cached.dispatch(Q((1,))) == 3
    now[0] = 11
    assert cached.dispatch(Q((1,)), "u") == 4
    cached.events({"Other"})
    assert cached.dispatch(Q((1,)), "u") == 4
    cached.events({"Changed"})
    assert cached.dispatch(Q((1,)), "u") == 5
    with pytest.raises(ValueError):
        bus.dispatch("nothing")


def test_cron():
    from datetime import timezone

    from logweir.functions.cron import Cron

    at = lambda *x: datetime(*x, tzinfo=timezone.utc)
    assert Cron("0 */15 * * * *").next_fire(at(2024, 1, 1, 0, 0)) == at(2024, 1, 1, 0, 15)
    assert Cron("30 0 9 * * MON-FRI").next_fire(at(2024, 1, 5, 9, 0, 30)) == at(2024, 1, 8, 9, 0, 30)
    assert Cron("0 0 0 L * *").next_fire(at(2024, 2, 1)) == at(2024, 2, 29)
    assert Cron("0 0 0 * * TUE#2").next_fire(at(2024, 1, 1)) == at(2024, 1, 9)
    assert Cron("@daily", "Europe/Berlin").next_fire(at(2024, 1, 1)) == at(2024, 1, 1, 23)
    assert Cron("0 30 2 * * *", "Europe/Berlin").next_fire(at(2024, 3, 30, 12)).astimezone(timezone.utc) == at(2024, 4, 1, 0, 30)
    assert Cron("0 0 0 30 2 *").next_fire(at(2024, 1, 1)) is None
    for bad in ("* * * * *", "61 * * * * *", "0 0 0 5-1 * *"):
        with pytest.raises(ValueError):
            Cron(bad)


def test_runners_of_several_projections(spark, tmp_path):
    from logweir.functions.cron import Cron

    events = spark.range(1, 5).select(F.col("id").alias("global_offset"))
    r = runner.Runner(spark, lambda: events, str(tmp_path), wait=lambda s: None)

    def fails(rows):
        raise ValueError("no")

    got = runner.run_all(r, [runner.Projection("a", lambda rows: None), runner.Projection("b", fails)])
    assert got["a"] == 1 and isinstance(got["b"], ValueError) and r.position("a")["offset"] == 4 and r.position("b")["offset"] == 0
    from datetime import timezone

    assert runner.run_scheduled(r, runner.Projection("c", lambda rows: None), Cron("@hourly"), lambda: datetime(2024, 1, 1, tzinfo=timezone.utc), 2) == [1, 0]


def test_one_stream_as_a_query(spark, tmp_path):
    store = log.StoredLog(spark, str(tmp_path / "log"))
    inline = []
    store.after_commit += [lambda rows: inline.append(rows.count()), lambda rows: 1 / 0]
    for i in (1, 2):
        store.append(f"cart:{i}", [{"event_type": "A", "payload": {}, "metadata": meta(i)}], 0)
    assert inline == [1, 1]
    got = []
    runner.follow_stream(spark, f"{store.path}/events", schema.EVENT_LOG, "cart", "2", lambda rows, _: got.extend(rows.collect()), str(tmp_path / "ck")).awaitTermination()
    assert [r["aggregate_id"] for r in got] == ["2"]
    every = []
    runner.follow(spark, f"{store.path}/events", schema.EVENT_LOG, runner.once(lambda rows: every.extend(rows.collect()), lambda: 1), str(tmp_path / "ck2")).awaitTermination()
    assert [r["global_offset"] for r in every] == [2]
    assert schema.invalid_ids(store.events()).count() == 0


def test_snapshots_of_a_purged_generation_are_not_saved(spark):
    kind = "aggregate_type string, aggregate_id string, version long, state string, purge_generation long"
    stored = spark.createDataFrame([("a", "1", 5, "x", 0), ("a", "2", 5, "y", 0)], kind)
    purged = fold.purge_snapshots(stored, stored.where("aggregate_id = '1'"))
    new = spark.createDataFrame([("a", "1", 9, "n", 0), ("a", "2", 9, "n", 0), ("a", "3", 2, "n", 0)], kind)
    got = {r["aggregate_id"]: (r["version"], r["state"], r["purge_generation"]) for r in fold.save_snapshots(purged, new).collect()}
    assert got == {"1": (5, None, 1), "2": (9, "n", 0), "3": (2, "n", 0)}


def test_outbox_inserts_and_leases(spark):
    box = outbox(spark, [(1, "a", "PENDING")])
    more = outbox(spark, [(1, "a", "PENDING"), (2, "a", "IN_PROGRESS"), (2, "a", "IN_PROGRESS")])
    full = workqueue.insert(box, more)
    assert sorted(r["seq"] for r in full.collect()) == [1, 2]
    late = full.withColumn("claimed_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {r["seq"]: r["status"] for r in workqueue.reclaimed(late, "2024-01-01 00:01:00", "claimed_at", 60).collect()} == {1: "PENDING", 2: "IN_PROGRESS"}  # on the bound the claim holds
    assert {(r["status"], r["claimed_at"]) for r in workqueue.reclaimed(late.where("seq = 2"), "2024-01-01 00:01:01", "claimed_at", 60).collect()} == {("PENDING", None)}
    letters = spark.createDataFrame([(1, "k", datetime(2024, 1, 1)), (2, "k", datetime(2024, 1, 2)), (3, "m", datetime(2024, 1, 2))], "n long, idempotency_key string, published_at timestamp")
    assert [r["n"] for r in workqueue.newest_letters(letters, 2).collect()] == [3, 2] and [r["n"] for r in workqueue.letters_of_key(letters, "k").collect()] == [1, 2]


def test_audit_rows(spark):
    rows = spark.createDataFrame([("c1", None, False, 3), ("c2", "boom", False, 3), ("c3", None, True, None)], "command_id string, error string, vetoed boolean, n_events int")
    assert [(r["outcome"], r["event_count"]) for r in audit.command_rows(rows).orderBy("command_id").collect()] == [("SUCCESS", 3), ("FAILURE", 0), ("VETOED", 0)]


def test_views_are_laid_out_by_their_index(spark, tmp_path):
    readmodel.write_view(spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("rank")), str(tmp_path / "v"), ("rank",), 4)
    back = spark.read.parquet(str(tmp_path / "v"))
    spread = back.groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("rank").alias("n")).collect()
    assert back.count() == 1000 and max(r["n"] for r in spread) <= 3


def test_keyed_folds_do_not_depend_on_batches(spark, tmp_path):
    from logweir.streaming.state import KeyedFold

    kinds = ["signup", "click", "error", "purchase", "view"]
    rows = [(i + 1, "user", str(i * 7 % 5), i // 5 + 1, kinds[(i * i + i // 3) % 5]) for i in range(60)]
    events = spark.createDataFrame(rows, "global_offset long, aggregate_type string, aggregate_id string, version long, event_type string")
    want = {r["aggregate_id"]: (r["status"], r["n_steps"], r["last_offset"]) for r in saga.saga_states(events, "signup", "purchase", "error").collect()}
    start = lambda: F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("n_steps"), F.lit(-1).cast("long").alias("last_offset"))
    op = KeyedFold(spark, str(tmp_path / "s"), ("aggregate_type", "aggregate_id"), ("event_type",), start, lambda a, e: saga.step(a, e, "signup", "purchase", "error"))
    for a, b in ((1, 10), (5, 30), (31, 60), (1, 60)):
        op.process(events.where(F.col("global_offset").between(a, b)))
    got = {r["aggregate_id"]: tuple(r["state"]) for r in op.states().collect() if r["state"]["status"] is not None}
    assert got == want and op.store.pointer()["fence"] == 60
