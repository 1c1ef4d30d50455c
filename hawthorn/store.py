"""A versioned rule store on Parquet folders: rules, documents, change log, import batches; optimistic writers.

Data folders are written first, each under a new name. A commit is one file, commits/<version>, that names the
folders of the state; it is written under another name and renamed without overwriting. So readers see the
state before or after, whatever fails in between, and of two writers that started from one version the second
gets CommitConflict. Nothing that a commit names is ever changed.

Rules lie in buckets by id: an edit writes the bucket of its rule, an import the buckets it touches. Log and batches
are appended. All times are UTC.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators.diff import classify
from .operators.numbering import numbered
from .schema import CATEGORIES, FIELDS, OPTIONAL, category_spec

CONTENT = [f for f in FIELDS if f not in ("sequence_no", "category_name")]
RULES = (
    "id long, sequence_no int, " + ", ".join(f"{f} string" for f in CONTENT) + ", category_code string, source_document_id long, source_sheet string, source_row int, "
    "content_hash string, status string, version int, created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
DOCUMENTS = "id long, file_name string"
LOGS = "id long, rule_id long, rule_no string, batch_id long, action string, old_values string, new_values string, created_at timestamp"
BATCHES = "id long, source_file_name string, source_file_sha256 string, status string, expected_count long, inserted_count long, updated_count long, unchanged_count long, failed_count long, error_message string, created_at timestamp"
SCHEMAS = {"rules": RULES, "documents": DOCUMENTS, "logs": LOGS, "batches": BATCHES}
EMPTY = {"rules": {}, "documents": [], "logs": [], "batches": [], "next": {"rules": 1, "documents": 1, "logs": 1, "batches": 1}, "migrations": []}
#: Buckets of rules, and folders of a log beyond which the next commit writes them as one.
BUCKETS, FOLDERS = 16, 64


class ImportConflict(Exception):
    """Changed rules where updates aren't allowed, or rules that are archived."""


class CommitConflict(Exception):
    """Another writer has committed since this one read the store."""


def content_digest() -> Column:
    """One canonical digest of a rule's content, whoever wrote it."""
    return tx.hash_object({c: F.col(c) for c in [*CONTENT, "category_code"]})


def _bucket(c: str = "id") -> Column:
    return F.pmod(F.col(c), F.lit(BUCKETS)).cast("string")


class RuleStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    # -- versions ------------------------------------------------------------
    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        fs, folder = self._fs(), self._at("commits")
        return max((int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0) if fs.exists(folder) else 0

    def state(self, version: int | None = None) -> dict:
        """What a version (the newest) consists of."""
        v = self.version() if version is None else version
        if not v:
            return json.loads(json.dumps(EMPTY)) | {"version": 0}
        stream = self._fs().open(self._at(f"commits/{v:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _folder(self, name: str) -> str:
        return f"{self.path}/data/{name}-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, name: str) -> str:
        folder = self._folder(name)
        df.write.parquet(folder)
        return folder

    def _publish(self, state: dict) -> None:
        """The commit: a file that is complete before it has its name, and takes it only if nobody has."""
        v, fs = state["version"], self._fs()
        draft = self._at(f"commits/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        target = self._at(f"commits/{v:020d}")
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise CommitConflict(f"version {v} has been committed by another writer") from e
            raise

    def _commit(self, state: dict, rules: dict | None = None, documents: DataFrame | None = None, logs: DataFrame | None = None, batches: DataFrame | None = None, moved: dict | None = None) -> int:
        """Writes what is new on top of state, then publishes the next version."""
        new = json.loads(json.dumps(state)) | {"version": state["version"] + 1}
        for bucket, folder in (rules or {}).items():
            new["rules"][bucket] = folder
        for name, df in (("documents", documents), ("logs", logs), ("batches", batches)):
            if df is None:
                continue
            if len(new[name]) >= FOLDERS:
                df, new[name] = df.unionByName(self._frame(state, name)), []
            new[name] = [*new[name], self._write(df, name)]
        new["next"] |= moved or {}
        self._publish(new)
        return new["version"]

    def _frame(self, state: dict, name: str, buckets: list[str] | None = None) -> DataFrame:
        folders = state[name]
        if name == "rules":
            folders = [f for b, f in folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def rules(self) -> DataFrame:
        return self._frame(self.state(), "rules")

    def documents(self) -> DataFrame:
        return self._frame(self.state(), "documents")

    def logs(self) -> DataFrame:
        return self._frame(self.state(), "logs")

    def batches(self) -> DataFrame:
        return self._frame(self.state(), "batches")

    def active(self) -> DataFrame:
        return self.rules().filter("deleted_at IS NULL")

    def migrate(self) -> list[str]:
        """Applies each pending migration once, in order; those that this call has applied."""
        state = self.state()
        pending = [(name, step) for name, step in MIGRATIONS if name not in state["migrations"]]
        if not pending:
            return []
        changes: dict = {}
        for _, step in pending:
            changes |= step(self, state)
        self._commit(state | {"migrations": [*state["migrations"], *(name for name, _ in pending)]}, **changes)
        return [name for name, _ in pending]

    @staticmethod
    def _json() -> Column:
        return F.to_json(F.struct(*[F.col(c) for c in [*CONTENT, "category_code", "status", "version"]]), {"ignoreNullFields": "false"})

    def _batch(self, state: dict, name: str, sha: str, status: str, counts: dict, message: str | None = None) -> DataFrame:
        row = (state["next"]["batches"], name, sha, status, counts.get("expected", 0), counts.get("inserted", 0), counts.get("updated", 0), counts.get("unchanged", 0), counts.get("failed", 0), message, None)
        return self.spark.createDataFrame([row], BATCHES).withColumn("created_at", F.current_timestamp())

    def _refuse(self, state: dict, file_name: str, sha256: str, status: str, counts: dict, message: str) -> None:
        self._commit(state, batches=self._batch(state, file_name, sha256, status, counts, message), moved={"batches": state["next"]["batches"] + 1})

    def _rewritten(self, state: dict, rows: DataFrame, buckets: list[str]) -> dict[str, str]:
        """Folders for the touched buckets: their rules, those of rows in place of older ones of the same id."""
        old = self._frame(state, "rules", buckets).join(rows.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
        folder = self._folder("rules")
        old.unionByName(rows).withColumn("bucket", _bucket()).write.partitionBy("bucket").parquet(folder)
        return {b: f"{folder}/bucket={b}" for b in buckets}

    def _document_ids(self, state: dict, names: DataFrame) -> tuple[DataFrame | None, DataFrame, int]:
        """Documents to add for names (file_name) that aren't there, all documents then, and the next id."""
        have = self._frame(state, "documents")
        fresh = names.select("file_name").distinct().join(have.select("file_name"), "file_name", "left_anti")
        if fresh.isEmpty():
            return None, have, state["next"]["documents"]
        added = numbered(fresh, ["file_name"], state["next"]["documents"], self._folder("staged")).select("id", "file_name")
        return added, have.unionByName(added), state["next"]["documents"] + added.count()

    # -- import --------------------------------------------------------------
    def import_rows(self, rows: DataFrame, file_name: str, sha256: str = "", update_existing: bool = False) -> dict:
        """Rows of a validated workbook (as of parse_rows): inserted, updated or unchanged by content; all or nothing.

        A conflict and a failure leave a batch of that status and nothing else.
        """
        state = self.state()
        try:
            return self._import(state, rows, file_name, sha256, update_existing)
        except (ImportConflict, CommitConflict):
            raise
        except Exception as e:
            self._refuse(state, file_name, sha256, "failed", {}, f"{type(e).__name__}: {e}"[:2000])
            raise

    def _import(self, state: dict, rows: DataFrame, file_name: str, sha256: str, update_existing: bool) -> dict:
        prepared = rows.select(
            F.col("sequence").alias("sequence_no"), *[(F.nullif(F.col(c), F.lit("")) if c in OPTIONAL else F.col(c)).alias(c) for c in CONTENT],
            "category_code", F.col("sheet").alias("source_sheet"), F.col("row_no").alias("source_row"),
        ).withColumn("content_hash", content_digest())
        old = self._frame(state, "rules")
        actions = classify(prepared, old.select("rule_no", "content_hash", F.col("deleted_at").isNotNull().alias("gone")), "rule_no", archived="gone")
        actions = self.spark.read.parquet(self._write(actions, "staged"))
        n = {r.action: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
        total = sum(n.values())
        blocked = n.get("archived_conflict", 0) + (0 if update_existing else n.get("update", 0))
        if blocked:
            ids = [r.rule_no for r in actions.filter("action IN ('archived_conflict', 'update')").orderBy("rule_no").limit(11).collect()]
            message = f"{blocked} rules in conflict: " + ", ".join(ids[:10]) + (" ..." if len(ids) > 10 else "")
            self._refuse(state, file_name, sha256, "conflict", {"expected": total, "unchanged": total - n.get("update", 0), "failed": blocked}, message)
            raise ImportConflict(message)
        counts = {"expected": total, "inserted": n.get("insert", 0), "updated": n.get("update", 0), "unchanged": n.get("unchanged", 0)}
        batch_id = state["next"]["batches"]
        batch, moved = self._batch(state, file_name, sha256, "success", counts), {"batches": batch_id + 1}
        changed = actions.filter("action IN ('insert', 'update')")
        if not counts["inserted"] and not counts["updated"]:
            self._commit(state, batches=batch, moved=moved)
            return {"batch_id": batch_id, **counts}
        documents, named, next_document = self._document_ids(state, changed.select(F.col("source_file").alias("file_name")))
        document = named.select(F.col("id").alias("source_document_id"), F.col("file_name").alias("_file"))
        columns = ["sequence_no", *CONTENT, "category_code", "source_sheet", "source_row", "content_hash"]
        fresh = numbered(actions.filter("action = 'insert'").select(*columns), ["category_code", "sequence_no", "rule_no"], state["next"]["rules"], self._folder("staged"))
        fresh = fresh.withColumns({"status": F.lit("published"), "version": F.lit(1), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "deleted_at": F.lit(None).cast("timestamp"), "old_values": F.lit(None).cast("string")})
        held = old.select(F.col("rule_no").alias("_no"), "id", "status", (F.col("version") + 1).alias("version"), "created_at", "deleted_at", self._json().alias("old_values"))
        again = actions.filter("action = 'update'").select(*columns).join(held, F.col("rule_no") == F.col("_no")).withColumn("updated_at", F.current_timestamp())
        names = [f.split()[0] for f in RULES.split(", ")]
        both = fresh.select(*[c for c in names if c != "source_document_id"], "old_values").unionByName(again.select(*[c for c in names if c != "source_document_id"], "old_values"))
        both = both.join(document, F.col("source_file") == F.col("_file")).select(*names, "old_values")
        both = self.spark.read.parquet(self._write(both, "staged"))
        buckets = sorted(r.b for r in both.select(_bucket().alias("b")).distinct().collect())
        action = F.when(F.col("old_values").isNull(), "insert").otherwise("update")
        logs = both.select(F.col("id").alias("rule_id"), "rule_no", F.lit(batch_id).cast("long").alias("batch_id"), action.alias("action"), "old_values", self._json().alias("new_values"), F.current_timestamp().alias("created_at"))
        logs = numbered(logs, ["rule_id"], state["next"]["logs"], self._folder("staged"))
        moved |= {"documents": next_document, "rules": state["next"]["rules"] + counts["inserted"], "logs": state["next"]["logs"] + counts["inserted"] + counts["updated"]}
        self._commit(state, rules=self._rewritten(state, both.select(*names), buckets), documents=documents, logs=logs, batches=batch, moved=moved)
        return {"batch_id": batch_id, **counts}

    # -- single rules --------------------------------------------------------
    def next_number(self, category: str) -> str:
        """The next free number of a category, archived rules counted."""
        mine = F.col("rule_no").rlike(f"^{category}-[0-9]+$")
        top = self.rules().filter((F.col("category_code") == category) & mine).agg(F.max(F.regexp_extract("rule_no", r"-(\d+)$", 1).try_cast("int"))).first()[0] or 0
        return f"{category}-{top + 1:03d}"

    def _edit(self, state: dict, new: DataFrame, rule_id: int, action: str, before: DataFrame, documents: DataFrame | None = None, moved: dict | None = None) -> None:
        """Commits one rule and its log row."""
        old = before.select(F.col("id").alias("_id"), self._json().alias("old_values"))
        log = new.join(old, F.col("id") == F.col("_id"), "left").select(
            F.lit(state["next"]["logs"]).cast("long").alias("id"), F.col("id").alias("rule_id"), "rule_no", F.lit(None).cast("long").alias("batch_id"), F.lit(action).alias("action"), "old_values", self._json().alias("new_values"), F.current_timestamp().alias("created_at")
        )
        rules = self._rewritten(state, new, [str(rule_id % BUCKETS)])
        self._commit(state, rules=rules, documents=documents, logs=log, moved={"logs": state["next"]["logs"] + 1} | (moved or {}))

    def save_rule(self, values: dict, original: str | None = None) -> str:
        """Inserts or updates one rule from a form; ValueError says what is wrong with it."""
        v = {k: (str(x).strip() if x is not None else "") for k, x in values.items()}
        v["status"] = v.get("status") or "published"
        if v.get("category_code") not in {c[0] for c in CATEGORIES}:
            raise ValueError("unknown category")
        if not v.get("rule_no", "").startswith(v["category_code"] + "-"):
            raise ValueError("rule_no lacks the category's prefix")
        if v["status"] not in ("published", "draft"):
            raise ValueError("status must be published or draft")
        missing = [f for f in ("rule_no", "rule_name", "subtype", "applicable_scope", "rule_content", "source_file", "source_page", "source_basis") if not v.get(f)]
        if missing:
            raise ValueError("missing: " + ", ".join(missing))
        state = self.state()
        old = self._frame(state, "rules")
        same = old.filter(F.col("rule_no").isin(v["rule_no"], original or v["rule_no"])).collect()
        if original and not any(r.rule_no == original for r in same):
            raise ValueError("no such rule")
        if any(r.rule_no == v["rule_no"] and r.rule_no != original for r in same):
            raise ValueError("rule_no is in use")
        target = next((r for r in same if r.rule_no == original), None)
        if target is not None and target.deleted_at is not None:
            raise ValueError("the rule is archived")
        content = {c: (v.get(c) or None) if c in OPTIONAL else v.get(c) for c in CONTENT}
        content["knowledge_type"] = next(k for c, _, k, _, _ in CATEGORIES if c == v["category_code"])
        sequence = old.filter(F.col("category_code") == v["category_code"]).agg(F.coalesce(F.max("sequence_no"), F.lit(0)) + 1).first()[0]
        documents, named, next_document = self._document_ids(state, self.spark.createDataFrame([(v["source_file"],)], "file_name string"))
        row = {
            "id": target.id if target else state["next"]["rules"], "sequence_no": target.sequence_no if target else sequence, **content, "category_code": v["category_code"],
            "source_document_id": named.filter(F.col("file_name") == v["source_file"]).first().id,
            "source_sheet": target.source_sheet if target else "系统录入", "source_row": target.source_row if target else 0, "content_hash": None, "status": v["status"],
            "version": target.version + 1 if target else 1, "created_at": target.created_at if target else None, "updated_at": None, "deleted_at": None,
        }
        names = [f.split()[0] for f in RULES.split(", ")]
        new = self.spark.createDataFrame([tuple(row[n] for n in names)], RULES)
        new = new.withColumns({"content_hash": content_digest(), "created_at": F.coalesce("created_at", F.current_timestamp()), "updated_at": F.current_timestamp()})
        moved = {"documents": next_document} | ({} if target else {"rules": state["next"]["rules"] + 1})
        self._edit(state, new, row["id"], "update" if target else "insert", old.filter(F.col("id") == row["id"]), documents, moved)
        return v["rule_no"]

    def set_archived(self, rule_no: str, archived: bool) -> bool:
        """Archives or restores (as published) a rule; False where it is so already."""
        state = self.state()
        mine = self._frame(state, "rules").filter(F.col("rule_no") == rule_no)
        row = mine.first()
        if row is None:
            raise ValueError("no such rule")
        if (row.deleted_at is not None) == archived:
            return False
        when = F.current_timestamp() if archived else F.lit(None).cast("timestamp")
        new = mine.withColumns({"status": F.lit("archived" if archived else "published"), "version": F.col("version") + 1, "deleted_at": when, "updated_at": F.current_timestamp()})
        self._edit(state, new, row.id, "archive" if archived else "restore", mine)
        return True

    # -- queries -------------------------------------------------------------
    def _named(self) -> DataFrame:
        """Rules with the names of their document and category."""
        state = self.state()
        documents = self._frame(state, "documents").select(F.col("id").alias("_d"), "file_name")
        spec = category_spec(self.spark).select(F.col("code").alias("_c"), F.col("sheet_name").alias("category_name"), "display_order")
        return self._frame(state, "rules").join(documents, F.col("source_document_id") == F.col("_d")).join(F.broadcast(spec), F.col("category_code") == F.col("_c")).drop("_d", "_c")

    def get(self, rule_no: str) -> dict | None:
        row = self._named().filter(F.col("rule_no") == rule_no).drop("display_order").first()
        return row.asDict() if row else None

    def search(self, keyword: str | None = None, category: str | None = None, status: str | None = None) -> DataFrame:
        from .plans.rules import by_category, by_status

        columns = [F.col(c) for c in ("rule_no", "rule_name", "rule_content", "subtype", "applicable_scope", "source_basis", "file_name")]
        return self._named().filter(by_status(status) & by_category(category) & tx.contains_any(columns, keyword))

    def page(self, keyword: str | None = None, category: str | None = None, status: str | None = None, page: int = 1, page_size: int | None = None) -> tuple[DataFrame, dict]:
        """A page of rules by category, sequence and number, and its figures with the pages before and after."""
        from .plans.rules import page_of

        rows, figures = page_of(self.search(keyword, category, status), ["display_order", "sequence_no", "rule_no"], page, page_size)
        columns = ["rule_no", "rule_name", "category_name", "category_code", "subtype", F.col("file_name").alias("source_file"), "status", "version", "updated_at"]
        return rows.select(*columns), figures

    def find(self, keyword: str, category: str | None = None, limit: int = 20) -> DataFrame:
        """Keyword search in active rules' own columns, by number; at most 200."""
        from .plans.rules import by_category, clamp

        columns = [F.col(c) for c in ("rule_no", "rule_name", "rule_content", "subtype", "applicable_scope", "source_basis")]
        rows = self.active().filter(by_category(category) & tx.contains_any(columns, keyword)).orderBy("rule_no").limit(clamp(limit, 1, 200, 20))
        return rows.select("rule_no", "rule_name", "category_code", "subtype", "applicable_scope", "trigger_condition", "rule_content", "parameter_text", "source_page", "source_basis")

    def stats(self) -> DataFrame:
        """Active rules of each category, none left out."""
        n = self.active().groupBy(F.col("category_code").alias("c")).agg(F.count("*").alias("n"))
        return category_spec(self.spark).join(n, F.col("code") == F.col("c"), "left").select("code", "sheet_name", F.coalesce("n", F.lit(0)).alias("rules"), "display_order").orderBy("display_order")

    def dashboard(self) -> dict:
        """Counts by state, documents, categories with their share, the eight largest subtypes, the five latest changes."""
        rules, alive = self.rules(), F.col("deleted_at").isNull()
        one = rules.agg(F.count_if(alive).alias("active"), F.count_if(alive & (F.col("status") == "draft")).alias("draft"), F.count_if(~alive).alias("archived"), F.countDistinct(F.when(alive, F.col("source_document_id"))).alias("sources")).first()
        subtypes = rules.filter(alive).groupBy("subtype").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "subtype").limit(8)
        recent = rules.orderBy(F.desc("updated_at"), F.desc("id")).limit(5).select("rule_no", "rule_name", "updated_at")
        categories = [r.asDict() | {"percent": round(r.rules / one.active * 100, 1) if one.active else 0} for r in self.stats().collect()]
        return one.asDict() | {"categories": categories, "subtypes": [r.asDict() for r in subtypes.collect()], "recent": [r.asDict() for r in recent.collect()]}

    def latest_batches(self, limit: int = 50) -> DataFrame:
        return self.batches().orderBy(F.desc("id")).limit(max(1, min(200, limit)))

    def changes(self, rule_no: str, limit: int = 20) -> DataFrame:
        """The latest changes of the rule that has this number now, under whatever number they were made."""
        state = self.state()
        rule = self._frame(state, "rules").filter(F.col("rule_no") == rule_no).select(F.col("id").alias("_id"))
        return self._frame(state, "logs").join(F.broadcast(rule.limit(1)), F.col("rule_id") == F.col("_id")).drop("_id").orderBy(F.desc("id")).limit(max(1, min(100, limit)))


def _with_documents(store: RuleStore, state: dict) -> dict:
    """Documents for rules that were written without: by name, in order of name."""
    rules = store._frame(state, "rules").filter("source_document_id IS NULL")
    if rules.isEmpty():
        return {}
    documents, named, top = store._document_ids(state, rules.select(F.col("source_file").alias("file_name")))
    names = [f.split()[0] for f in RULES.split(", ")]
    joined = rules.drop("source_document_id").join(named.select(F.col("id").alias("source_document_id"), F.col("file_name").alias("_f")), F.col("source_file") == F.col("_f")).select(*names)
    joined = store.spark.read.schema(RULES).parquet(store._write(joined, "staged"))
    buckets = sorted(r.b for r in joined.select(_bucket().alias("b")).distinct().collect())
    return {"rules": store._rewritten(state, joined, buckets), "documents": documents, "moved": {"documents": top}}


#: Migrations in order; each gives what it changes (arguments of a commit).
MIGRATIONS = [("001_initial", lambda store, state: {}), ("002_documents", _with_documents)]
