from pyspark.sql import functions as F

from hitlytics.functions.times import epoch_ms
from hitlytics.operators import catalog, raw_hits, registry
from hitlytics.plans import analytics, scope
from hitlytics.schema import ROLLUP

from helpers import EPOCH, at, hex_id, rows


def test_scopes(spark):
    clients = spark.createDataFrame([(hex_id(1),)], "client_id string")
    users = spark.createDataFrame([
        ("admin", "super_admin", None, False, None),
        ("admin one", "super_admin", None, False, hex_id(1)),
        ("admin bad", "super_admin", None, False, "x"),
        ("admin none", "super_admin", None, False, hex_id(5)),
        ("viewer", "client_viewer", hex_id(1), True, hex_id(5)),
        ("blind", "client_viewer", hex_id(1), False, None),
        ("free", "client_admin", None, True, None),
        ("odd", "client_admin", "x", True, None),
        ("lost", "client_admin", hex_id(5), True, None),
    ], "user_id string, role string, client_id string, can_view_analytics boolean, requested_client_id string")
    assert rows(scope.resolve(users, clients), "user_id", "scope", "scope_error") == sorted([
        ("admin", "*", None), ("admin one", hex_id(1), None), ("admin bad", None, scope.BAD_CLIENT_ID),
        ("admin none", None, scope.UNKNOWN_CLIENT), ("viewer", hex_id(1), None), ("blind", None, scope.FORBIDDEN),
        ("free", None, scope.NO_CLIENT), ("odd", None, scope.BAD_CLIENT), ("lost", None, scope.UNKNOWN_CLIENT)])


def test_entitled_stats_equal_the_single_report(spark):
    data = [(hex_id(c), s, e, "GET", at(0), 3 + c, c, 1000 * c, 0, 9) for c in (1, 2) for s in "ab" for e in ("/", "/x")]
    rollup = spark.createDataFrame(data, ROLLUP)
    scopes = spark.createDataFrame(
        [("root", "*"), ("one", hex_id(1)), ("idle", hex_id(3)), ("none", None)], "user_id string, scope string")
    now = epoch_ms(EPOCH) + 1000
    got = {r["user_id"]: r for r in analytics.entitled_stats(rollup, scopes, now).collect()}
    assert set(got) == {"root", "one", "idle"}
    for user, client in (("root", None), ("one", hex_id(1)), ("idle", hex_id(3))):
        assert got[user][2:] == analytics.overall_stats(rollup, now, client).first()[:7]


def test_audit_names_every_broken_rule(spark):
    clients = spark.sql("""select 'c1' client_id, 'ab' name, 'Bad slug' slug, '' email, repeat('x', 501) description,
        6 retention_days union all select 'c2', 'fine', 'fine-1', 'a@b.c', '', 30""")
    keys = spark.sql("""select 'k1' api_key_id, repeat('n', 101) name, '' description, 'lab' environment,
        array('1.2.3.4', 'x') allowed_ips, array('*', 'ftp://x') allowed_origins, repeat('p', 201) purpose,
        array(repeat('t', 51)) tags union all
        select 'k2', 'n', null, 'staging', array('1.2.3.4/24', '0.0.0.0/0'), array('https://a.b'), null, array()""")
    users = spark.sql("""select 'u1' user_id, 'a!' username, 'no mail' email, 'boss' role, string(null) client_id
        union all select 'u2', 'ada.l_1', 'a@b.c', 'super_admin', null""")
    bare = registry.audit(clients, keys, users)  # columns that are not there are absent in every row
    assert {(r["row_id"], r["rule"]) for r in bare.collect() if r["row_id"].endswith("2")} == {
        *[("c2", f"{c} is required") for c in ("is_active", "created_by")], ("u2", "password is required"),
        *[("k2", f"{c} is required") for c in ("key_id", "key_value", "client_id", "created_by")]}
    given = lambda df, *columns: df.withColumns({c: F.lit("given") for c in columns})
    found = registry.audit(given(clients, "is_active", "created_by"), given(keys, "key_id", "key_value", "client_id", "created_by"), given(users, "password"))
    assert {r["row_id"] for r in found.collect()} == {"c1", "k1", "u1"}
    assert found.groupBy("row_id").count().orderBy("row_id").collect() == [("c1", 5), ("k1", 6), ("u1", 5)]


def test_key_listing_hides_secrets(spark):
    keys = spark.createDataFrame(
        [("k1", "secret", "u1", at(1)), ("k2", "secret2", "gone", at(2))],
        "api_key_id string, key_value string, created_by string, created_at timestamp")
    users = spark.createDataFrame([("u1", "ada", "ada@x.y", "pw")], "user_id string, username string, email string, password string")
    listed = registry.keys_with_creator(keys, users)
    assert "key_value" not in listed.columns
    assert [tuple(r) for r in listed.select("api_key_id", "creator_id", "creator_name", "creator_email").collect()] == [
        ("k2", "", "", ""), ("k1", "u1", "ada", "ada@x.y")]
    assert registry.find_by(users, "username", "ADA").count() == 0
    assert registry.find_by(registry.public(users), "username", "ada").columns == ["user_id", "username", "email"]


def test_raw_listing_and_keyset_paging(spark):
    hits = spark.createDataFrame([(f"e{i:03d}", at(i // 3)) for i in range(150)], "event_id string, hit_ts timestamp")
    ordered = [r["event_id"] for r in raw_hits.find(hits, limit=150).collect()]
    assert len(raw_hits.find(hits).collect()) == 100
    assert [r["event_id"] for r in raw_hits.find(hits, skip=20, limit=5).collect()] == ordered[20:25]
    last = ordered[24]
    after = raw_hits.older_than(epoch_ms(at(int(last[1:]) // 3)), last)
    assert [r["event_id"] for r in raw_hits.find(hits, after, limit=5).collect()] == ordered[25:30]


def test_orphaned_children_are_reported(spark):
    parents = spark.createDataFrame([(1, "one"), (2, "two")], "post_id int, title string")
    children = spark.createDataFrame([(1, "a"), (1, "b"), (9, "c")], "post_id int, text string")
    assert rows(catalog.child_counts(parents, children, "post_id")) == [
        (1, 2, None), (2, 0, None), (9, 1, "Post not found")]
    assert rows(catalog.with_children(parents, children, "post_id", "title"), "text", "title", "total") == [
        ("a", "one", 2), ("b", "one", 2)]


def test_search(spark):
    posts = spark.createDataFrame([
        (1, "Maya Chen", ["observability", "Monitoring"]), (2, "Li", ["monitoring"]), (3, "maya", [])],
        "id int, author string, tags array<string>")
    assert rows(catalog.search(posts, F.col("id"), author="MAYA"), "id") == [(1,), (3,)]
    assert rows(catalog.search(posts, F.col("id"), tag="monitor", limit="1"), "id") == [(1,)]
    assert rows(catalog.search(posts, F.col("id"), author="", tag=None, limit="x"), "id") == [(1,), (2,), (3,)]
