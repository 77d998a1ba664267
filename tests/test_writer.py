"""Write verbs over a snapshot store."""

import datetime as dt

import pytest

from lodestone import errors
from lodestone.engine import Engine
from lodestone.functions.expressions import col, increment
from lodestone.operators.audit import LOG, Audit
from lodestone.operators.retention import Retention
from lodestone.operators.shards import ModShard
from lodestone.operators.writer import Conflict, Writer
from lodestone.schema import Model
from lodestone.sources.snapshots import Snapshots

NOW = dt.datetime(2026, 1, 1)


@pytest.fixture()
def blog(spark, tmp_path):
    e, store = Engine(spark), Snapshots(spark, str(tmp_path))
    posts = Model("posts").base().field("title", "string").field("views", "bigint", default=0).field("updated_by", "bigint").field("deleted_at", "timestamp", soft_delete=True).has_many("notes", "notes", "id", "post_id", order=("id",)).has_one("cover", "covers", "id", "post_id", order=("id",)).many_to_many("tags", "tags", "id", "post_tags", "post_id", "tag_id", "id", order=("id",))
    notes = Model("notes").field("id", "bigint", primary=True).field("post_id", "bigint").field("body", "string").belongs_to("post", "posts", "post_id", "id")
    covers = Model("covers").field("id", "bigint", primary=True).field("post_id", "bigint")
    tags = Model("tags").field("id", "bigint", primary=True).field("name", "string")
    e.register(posts, notes, covers, tags)
    for m in (posts, notes, covers, tags):
        store.write(m.table, spark.createDataFrame([], m.struct()))
    store.write("post_tags", spark.createDataFrame([], "post_id long, tag_id long, sort int"))
    w = Writer(e, store, Audit(9), lambda: NOW).share("posts", "notes", "covers", "tags", "post_tags")
    w.create("posts", [{"title": "A"}, {"title": "B"}])
    w.create("notes", [{"post_id": 1, "body": "n1"}, {"post_id": 1, "body": "n2"}, {"body": "free"}])
    w.create("covers", [{"post_id": 1}, {}] if False else [{"post_id": 1}, {"post_id": None}])
    w.create("tags", [{"name": "x"}, {"name": "y"}, {"name": "z"}])
    return e, w


def test_rows_by_query(blog):
    e, w = blog
    seen = []
    e.events.on("write", lambda p: seen.append((p["operation"], p["rows"])))
    assert w.update(e.use("posts").where_has("notes"), {"views": increment(5)}).affected == 1
    got = {r["title"]: r for r in e.use("posts").get()}
    assert (got["A"]["views"], got["A"]["updated_by"], got["B"]["views"], got["A"]["created_at"]) == (5, 9, 0, NOW)
    with pytest.raises(errors.UnsafeWrite):
        w.update(e.use("posts"), {"views": 1})
    assert w.delete(e.use("posts").where("title", "B")).affected == 1 and e.use("posts").count() == 1
    assert w.restore(e.use("posts").where("title", "B")).affected == 1 and e.use("posts").count() == 2
    assert w.force_delete(e.use("posts").where("title", "B")).affected == 1 and e.use("posts").with_deleted().count() == 1
    assert [s[0] for s in seen] == ["update", "delete", "restore", "delete"]
    up = w.upsert("tags", [{"id": 1, "name": "new"}, {"id": 9, "name": "nine"}], Conflict("id").update("name"))
    assert up.affected == 2 and {r["id"]: r["name"] for r in e.use("tags").get()} == {1: "new", 2: "y", 3: "z", 9: "nine"}
    with pytest.raises(errors.InvalidArgument):
        w.create("tags", {"nope": 1})


def test_relations(blog):
    e, w = blog
    posts, notes = e.registry.models["posts"], e.registry.models["notes"]
    a, b = e.use("posts").find(1), e.use("posts").find(2)
    tags = e.use("tags").order_by("id").get()
    w.attach(posts, a, "tags", tags[0], tags[1], data={"sort": 3})
    w.update_through(posts, a, "tags", tags[1], {"sort": 8})
    assert sorted(tuple(r) for r in e.table("post_tags").get()) == [(1, 1, 3), (1, 2, 8)]
    w.sync(posts, a, "tags", [tags[1], tags[2]])
    assert [t["id"] for t in e.use("posts").with_("tags").find(1)["tags"]] == [2, 3]
    w.sync(posts, a, "tags", [tags[0]], detaching=False)
    w.detach(posts, a, "tags", tags[2])
    assert [t["id"] for t in e.use("posts").with_("tags").find(1)["tags"]] == [1, 2]
    w.clear(posts, a, "tags")
    assert e.table("post_tags").count() == 0
    free, n1 = e.use("notes").find(3), e.use("notes").find(1)
    w.add(posts, b, "notes", free)
    w.remove(posts, b, "notes", n1)  # points at another post: stays
    w.remove(posts, a, "notes", n1)
    assert {r["id"]: r["post_id"] for r in e.use("notes").get()} == {1: None, 2: 1, 3: 2}
    w.set(notes, e.use("notes").find(1), "post", b)
    w.clear(posts, b, "notes")
    assert {r["id"]: r["post_id"] for r in e.use("notes").get()} == {1: None, 2: 1, 3: None}
    w.replace(posts, a, "cover", e.use("covers").find(2))
    assert {r["id"]: r["post_id"] for r in e.use("covers").get()} == {1: None, 2: 1}
    with pytest.raises(errors.Unsupported):
        w.set(posts, a, "notes", free)
    with pytest.raises(errors.Unsupported):
        w.attach(posts, a, "notes", free)


def test_hooks_tenants_shards_cleanup(spark, tmp_path):
    e, store = Engine(spark), Snapshots(spark, str(tmp_path))
    m = Model("logs").field("id", "bigint", primary=True).field("tenant_id", "bigint").field("action", "string").by_tenant("tenant_id").sharded(ModShard("tenant_id", 2)).on("before_create", lambda r: {**r, "action": r["action"].upper()})
    e.register(m)
    store.write("logs", spark.createDataFrame([], m.struct()))
    w = Writer(e, store).share("logs")
    with pytest.raises(errors.TenantRequired):
        w.create("logs", {"action": "x"})
    e.tenant_resolver = lambda: {"tenant_id": 4}
    w.create("logs", [{"action": f"a{k}"} for k in range(10)])
    assert {r["tenant_id"] for r in e.use("logs").get()} == {4} and e.use("logs").where(col("action").eq("A3")).count() == 1
    with pytest.raises(errors.ShardMismatch):
        w.create("logs", {"action": "x", "tenant_id": 5}, shard=4)
    e.tenant_resolver = lambda: {"tenant_id": 5}
    assert w.delete(e.use("logs").where("action", "A1")).affected == 0
    assert w.cleanup("logs", Retention(keep_last=3, key="id"), 2) == (7, 4)
    assert store.read("logs").count() == 3


def test_tenants_share_no_keys(spark, tmp_path):
    e, store = Engine(spark), Snapshots(spark, str(tmp_path))
    m = Model("rows").field("id", "bigint", primary=True).field("tenant_id", "bigint").field("code", "string").field("v", "string").by_tenant("tenant_id")
    e.register(m)
    store.write("rows", spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "b", "y")], "id long, tenant_id long, code string, v string"))
    w = Writer(e, store).share("rows")
    e.tenant_resolver = lambda: {"tenant_id": 1}
    with pytest.raises(errors.TenantMismatch):
        w.upsert("rows", {"id": 2, "v": "stolen"}, Conflict("id").update_all())
    w.upsert("rows", [{"id": 1, "v": "mine"}, {"id": 3, "v": "new"}], Conflict("id").update_all())
    assert {tuple(r) for r in store.read("rows").collect()} == {(1, 1, "a", "mine"), (2, 2, "b", "y"), (3, 1, None, "new")}


def test_audit_log_plugins_and_shards(spark, tmp_path):
    e, store = Engine(spark), Snapshots(spark, str(tmp_path))
    m = Model("docs").field("id", "bigint", primary=True).field("k", "bigint").field("title", "string", default="none").field("secret", "string", hidden=True).field("updated_by", "bigint").field("deleted_by", "bigint").field("deleted_at", "timestamp_ntz", soft_delete=True).sharded(ModShard("k", 2))
    e.register(m)
    store.write("docs", spark.createDataFrame([], m.struct()))
    store.write("log", spark.createDataFrame([], LOG))
    w, seen = Writer(e, store, Audit(5, "log"), lambda: NOW).share("docs", "log"), []

    class Plugin:
        def on_write(self, context):
            seen.append((context.mode, context.stage))
            if context.mode == "update":
                context.values["title"] = "plugged"

    for event in ("before_create", "after_create", "before_update", "after_update", "before_delete", "after_delete", "before_restore", "after_restore"):
        e.events.on(event, lambda p, event=event: seen.append(event))
    plugin = Plugin()
    before = store.version()
    w.create("docs", [{"k": 1, "title": "t", "secret": "s"}, {"k": 3}], shard=1, plugins=(plugin,))
    assert store.version() == before + 1  # rows and log together
    w.update(e.use("docs").apply(plugin).where("id", 1), {"title": "u"})
    w.delete(e.use("docs").apply(plugin).where("id", 2))
    gone = e.use("docs").only_deleted().find(2)
    assert (gone["deleted_by"], gone["updated_by"], gone["title"]) == (5, 5, "none")
    w.restore(e.use("docs").apply(plugin).where("id", 2))
    assert e.use("docs").find(2)["deleted_by"] is None and e.use("docs").find(1)["title"] == "plugged"
    log = store.read("log").orderBy("at").collect()
    assert sorted((r["operation"], r["key"]) for r in log) == [("create", "1"), ("create", "2"), ("delete", "2"), ("restore", "2"), ("update", "1")]
    assert all("secret" not in r["values"] and r["actor"] == "5" for r in log)
    assert seen == ["before_create", ("insert", "values"), ("after_write", "result"), "after_create", "before_update", ("update", "values"), ("after_write", "result"), "after_update",
                    "before_delete", ("delete", "values"), ("after_write", "result"), "after_delete", "before_restore", ("restore", "values"), ("after_write", "result"), "after_restore"]
    bulk = spark.createDataFrame([(7, 4)], "id long, k long")
    with pytest.raises(Exception, match="isn't in that shard"):
        w.create("docs", bulk, shard=1)
    with pytest.raises(errors.ShardMismatch):
        with e.transaction(store):
            w.create("docs", {"k": 1}, shard=1)
            w.create("docs", {"k": 2}, shard=2)
    w.create("docs", bulk, shard=2)
    with pytest.raises(errors.InvalidArgument):
        w.create("docs", {"k": 1}, batch_size=0)
    assert store.read("docs").count() == 3
