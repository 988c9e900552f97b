"""A session over a store: user, instant, transactions, SQL with a time-travel marker."""

from __future__ import annotations

import copy
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TableConfig, check_new, with_defaults
from ..errors import InvalidInstant, NotAllowed, NotSupported, NullInstant, ReadOnlyAsOf, TemporalError, UnknownTable
from ..operators import versions as V
from ..operators.versions import BY, DELETED_BY, FROM, ROW_ID, TO
from ..sources.store import Store
from ..sources.table import BUCKETS, TemporalTable

MARKER = re.compile(r"\btemporal\.as_of\s*\(\s*([^()]*?)\s*\)", re.IGNORECASE)
#: Texts, names in quotes and comments of a statement.
QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*(?s:.*?)\*/""")
INSTANT = re.compile(r"(?:TIMESTAMP(?:TZ)?\s*)?'([^']*)'(?:\s*::\s*timestamptz)?", re.IGNORECASE)


def bare(text: str) -> str:
    """A statement, letter by letter, with comments as blanks and the insides of texts as dots; names in backquotes stay."""

    def hide(found: re.Match) -> str:
        part = found[0]
        if part[0] == "`":
            return part
        return part[0] + "." * (len(part) - 2) + part[-1] if part[0] in "'\"" else " " * len(part)

    return QUOTED.sub(hide, text)


def names_in(text: str, names: Iterable[str]) -> list[str]:
    """Those of names that a bare statement has as words."""
    return [n for n in names if re.search(rf"(?<![\w.]){_spelled(n)}(?!\w)", text, re.IGNORECASE)]


def _spelled(name: str) -> str:
    """A name as a pattern, with or without backquotes."""
    return r"\.".join(f"`?{re.escape(x)}`?" for x in name.split("."))


def with_relations(text: str, relations: dict[str, str]) -> str:
    """A statement over relations of its own, which go before those of its WITH clause; of CREATE ... AS, over those of its query."""
    if not relations:
        return text
    own = ", ".join(f"`{n}` AS ({body})" for n, body in relations.items())
    plain = bare(text)
    at = 0
    if re.match(r"\s*CREATE\b", plain, re.IGNORECASE):
        found = re.search(r"\bAS\s*(?=\(|SELECT\b|WITH\b|VALUES\b|TABLE\b|FROM\b)", plain, re.IGNORECASE)
        at = found.end() if found else 0
    elif found := re.match(r"\s*EXPLAIN(\s+(EXTENDED|CODEGEN|COST|FORMATTED))?\s", plain, re.IGNORECASE):
        at = found.end()
    clause = re.compile(r"\s*WITH(\s+RECURSIVE)?\b", re.IGNORECASE).match(plain, at)
    if clause:
        return f"{text[:clause.end()]} {own}, {text[clause.end():]}"
    return f"{text[:at]} WITH {own} {text[at:]}"


def instant(value) -> datetime:
    """A moment from a datetime (UTC where it names no zone) or an ISO text."""
    if value is None:
        raise NullInstant("the instant is null")
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        except ValueError as error:
            raise InvalidInstant(f"no timestamp: {value!r}") from error
    if not isinstance(value, datetime):
        raise InvalidInstant(f"no timestamp: {value!r}")
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value


class TemporalSession:
    """user_id: a name or a function that gives one; clock: a function that gives the present."""

    def __init__(self, spark: SparkSession, path: str, user_id: str | Callable[[], str | None] | None = None, require_user: bool = False, clock: Callable[[], datetime] | None = None, read_only: bool = False, defaults: dict | None = None, buckets: int = BUCKETS):
        self.spark, self.store = spark, Store(spark, path)
        self.user_id, self.require_user, self.read_only = user_id, require_user, read_only
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.defaults, self.buckets = defaults or {}, buckets
        self.instant: datetime | None = None
        self._tx: dict | None = None
        self._tx_version, self._tx_time = 0, None
        self.on_commit: list[Callable[[int], None]] = []
        self.pins: list[str] = []

    # context

    @property
    def user(self) -> str | None:
        found = self.user_id() if callable(self.user_id) else self.user_id
        return found or None

    @contextmanager
    def as_user(self, user: str | None) -> Iterator[None]:
        before, self.user_id = self.user_id, user
        try:
            yield
        finally:
            self.user_id = before

    @contextmanager
    def as_of(self, t) -> Iterator[TemporalSession]:
        """All reads inside see the tables as they were at t; writes to them are refused. An empty text is the present."""
        before, self.instant = self.instant, None if t == "" else instant(t)
        try:
            yield self
        finally:
            self.instant = before

    def reject_as_of(self, what: str) -> None:
        if self.instant is not None:
            raise TemporalError(f"{what} can't be used while an instant is set")

    def reject_write(self, name: str) -> None:
        if self.instant is not None:
            raise ReadOnlyAsOf(f"{name} can't be written while an instant is set")
        if self.read_only:
            raise ReadOnlyAsOf(f"{name}: the session is read-only")

    # transactions

    @property
    def tx_time(self) -> datetime:
        return self._tx_time if self._tx is not None else self._now()

    def _now(self) -> datetime:
        return instant(self.clock())

    def _state(self) -> dict:
        return self._tx if self._tx is not None else self.store.latest()[1]

    @contextmanager
    def transaction(self) -> Iterator[TemporalSession]:
        """Statements inside share one time and are seen at once or not at all; a nested block is a savepoint."""
        if self._tx is not None:
            saved, moment = copy.deepcopy(self._tx), self.instant
            try:
                yield self
            except BaseException:
                self._tx, self.instant = saved, moment
                raise
            return
        self._tx_version, self._tx = self.store.latest()
        self._tx = copy.deepcopy(self._tx)
        self._tx_time, self._dirty = self._now(), False
        try:
            yield self
            if self._dirty:
                version = self.store.commit(self._tx_version, self._tx)
                for call in self.on_commit:
                    call(version)
        finally:
            self._tx, self._tx_time = None, None

    def _edit(self, change: Callable[[dict], None]) -> None:
        if self._tx is not None:
            change(self._tx)
            self._dirty = True
            return
        with self.transaction():
            self._edit(change)

    def change(self, name: str, **parts) -> None:
        self._edit(lambda state: state["tables"][name].update(parts))

    def configure(self, name: str, config: TableConfig) -> None:
        self.change(name, config=config.to_json())

    def pinned(self, df: DataFrame) -> DataFrame:
        """df as it is now, cut from what it was made of: written to the store's scratch folder."""
        path = f"{self.store.path}/scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.pins.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def unpin(self, since: int) -> None:
        """Delete what was pinned after the first ``since`` ones."""
        while len(self.pins) > since:
            self.store.remove(self.pins.pop())

    def with_row_ids(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with fresh ids where they have none; ids are never used again."""
        first = self.state_of(name)["next_row_id"]
        place = self.pinned(rows).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        # one row for each file: where its rows begin among all
        files = place.groupBy("_file").agg(F.count("*").alias("_n"))
        begin = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
        files = files.select("_file", F.coalesce(begin, F.lit(0)).alias("_begin"))
        self.change(name, next_row_id=first + place.count())
        fresh = F.lit(first) + F.col("_begin") + F.col("_at")
        return place.join(files, "_file").withColumn(ROW_ID, F.coalesce(ROW_ID, fresh)).select(*rows.columns)

    # catalog

    def state_of(self, name: str) -> dict:
        found = self._state()["tables"].get(name)
        if found is None or not found["tracked"]:
            raise UnknownTable(f"{name} is not tracked")
        return found

    def resolve(self, name: str) -> str:
        """The tracked table of a base, history or versions name."""
        tables = self._state()["tables"]
        for base in (name, name.removesuffix("__history"), name.removesuffix("__versions")):
            if base in tables and tables[base]["tracked"]:
                return base
        raise UnknownTable(f"{name} is not tracked")

    def table(self, name: str) -> TemporalTable:
        return TemporalTable(self, self.resolve(name))

    def tracked_tables(self) -> DataFrame:
        rows = [(n, list(x["config"]["key"]), list(x["config"]["excluded"]), float(x["config"]["combine_interval"]), x["config"]["include_indexes"], x["config"]["lineage"], f"{n[:51]}__history") for n, x in self._state()["tables"].items() if x["tracked"]]
        return self.spark.createDataFrame(rows, "table_name string, key array<string>, excluded array<string>, combine_interval double, include_indexes boolean, lineage boolean, history_table string")

    def enable(self, name: str, rows: DataFrame, config: TableConfig, not_null: tuple[str, ...] = (), history: DataFrame | str | None = None) -> TemporalTable:
        """Start to track rows under name; their versions begin now.

        history: the name of a table tracked before, or rows, whose history goes on.
        """
        self.reject_write(name)
        config = with_defaults(config, self.defaults)
        check_new(config, rows.schema)
        state = self._state()
        if name in state["tables"] and state["tables"][name]["tracked"]:
            raise TemporalError(f"{name} is already tracked")
        if name.endswith(("__history", "__versions")):
            raise TemporalError(f"{name} is the name of a history")
        app = [f for f in rows.schema if f.name not in (FROM, BY, *([ROW_ID] if config.lineage else []))]
        managed = [*([T.StructField(ROW_ID, T.LongType())] if config.lineage else []), T.StructField(FROM, T.TimestampType()), T.StructField(BY, T.StringType())]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in app] + managed)
        past = T.StructType([*schema, T.StructField(TO, T.TimestampType()), T.StructField(DELETED_BY, T.StringType())])
        old = state["tables"].get(history) if isinstance(history, str) else None
        tail, closed, end = ({}, [], None) if old is None else (old["tail"], old["closed"], old["newest_end"])
        buckets = self.buckets if old is None else old["buckets"]
        if old is not None:
            past = T.StructType.fromJson(old["history_schema"])
        if isinstance(history, DataFrame):
            kinds = dict(history.dtypes)
            for f in past:
                if kinds.get(f.name) != f.dataType.simpleString():
                    raise TemporalError(f"the history's {f.name} must be {f.dataType.simpleString()}")
            past = history.schema
        with self.transaction():
            self._edit(lambda s: s["tables"].__setitem__(name, {"tracked": True, "config": config.to_json(), "schema": schema.jsonValue(), "history_schema": past.jsonValue(), "base": {}, "tail": tail, "closed": closed, "newest_end": end, "not_null": list(not_null), "next_row_id": 1 if old is None else old["next_row_id"], "buckets": buckets}))
            found = TemporalTable(self, name)
            if isinstance(history, DataFrame):
                found._rewrite_history(history)
                latest = history.agg(F.max(TO)).head()[0]
                self.change(name, newest_end=latest and int(latest.timestamp() * 1e6))
            if not rows.isEmpty():
                with self._unattributed():
                    found.insert(rows)
        return found

    @contextmanager
    def _unattributed(self) -> Iterator[None]:
        before, self.require_user = self.require_user, False
        try:
            yield
        finally:
            self.require_user = before

    def disable(self, name: str) -> None:
        """Stop tracking; the history stays and can be taken up again. Policies go."""
        self.state_of(name)

        def change(state: dict) -> None:
            state["tables"][name]["tracked"] = False
            state["policies"] = {k: v for k, v in state["policies"].items() if k.split("/")[0] != name}

        self._edit(change)

    drop_table = disable

    def rename_table(self, old: str, new: str) -> None:
        """Tracking goes on under another name, or in another namespace."""
        self.state_of(old)
        if new in self._state()["tables"]:
            raise TemporalError(f"{new} exists")

        def change(state: dict) -> None:
            state["tables"][new] = state["tables"].pop(old)
            state["policies"] = {(f"{new}/{k.split('/')[1]}" if k.split("/")[0] == old else k): v for k, v in state["policies"].items()}

        self._edit(change)

    def apply_config(self, name: str, config: TableConfig) -> list[str]:
        """Move a table's settings to config; returns the names of those that changed."""
        table, before = self.table(name), self.table(name).config
        done = []
        for part, call in (("excluded", table.set_excluded_columns), ("combine_interval", table.set_combine_interval), ("include_indexes", table.set_include_indexes), ("codec", table.set_history_compression)):
            if getattr(before, part) != getattr(config, part):
                call(getattr(config, part))
                done.append(part)
        for part, kind in (("retention", "retention"), ("compaction", "compaction")):
            if getattr(before, part) != getattr(config, part):
                value = getattr(config, part)
                self.add_policy(name, kind, drop_after=value if kind == "retention" else None) if value else self.remove_policy(name, kind)
                done.append(part)
        if config.lineage != before.lineage or config.key != before.key:
            raise TemporalError("key and lineage can't change")
        return done

    # policies

    def add_policy(self, name: str, kind: str, drop_after: timedelta | None = None, run_every: timedelta = timedelta(days=1)) -> None:
        """kind: "retention" (with drop_after) or "compaction"; again: other settings, enabled, last run kept."""
        self.state_of(name)
        if kind not in ("retention", "compaction"):
            raise TemporalError(f"no policy of kind {kind}")
        if kind == "retention" and (drop_after is None or drop_after < timedelta(0)):
            raise TemporalError("drop_after must not be negative")

        def change(state: dict) -> None:
            last = state["policies"].get(f"{name}/{kind}", {}).get("last_run")
            state["policies"][f"{name}/{kind}"] = {"enabled": True, "drop_after": None if drop_after is None else drop_after.total_seconds(), "run_every": run_every.total_seconds(), "last_run": last}

        self._edit(change)

    def remove_policy(self, name: str, kind: str) -> None:
        self._edit(lambda state: state["policies"].pop(f"{name}/{kind}", None))

    def policies(self) -> DataFrame:
        rows = [(*k.split("/"), p["enabled"], p["drop_after"], p["run_every"], p["last_run"]) for k, p in self._state()["policies"].items()]
        return self.spark.createDataFrame(rows, "table_name string, kind string, enabled boolean, drop_after double, run_every double, last_run double")

    def run_due_policies(self, budget: timedelta = timedelta(minutes=5)) -> int:
        """Run what is due, longest unrun first, until the budget is spent; returns how many ran."""
        self.reject_as_of("run_due_policies")
        began, ran = self._now(), 0
        due = [(p["last_run"] is not None, p["last_run"] or 0, k, p) for k, p in self._state()["policies"].items() if p["enabled"] and (p["last_run"] is None or began.timestamp() - p["last_run"] >= p["run_every"])]
        for _, _, k, p in sorted(due, key=lambda x: x[:3]):
            if self._now() - began > budget:
                break
            name, kind = k.split("/")
            with self.transaction():
                if kind == "retention":
                    self.table(name).drop_history_before(began - timedelta(seconds=p["drop_after"]))
                else:
                    self.table(name).compact_history()
                self._edit(lambda state, k=k: state["policies"][k].update(last_run=began.timestamp()))
            ran += 1
        return ran

    # SQL

    def create_view(self, name: str, text: str) -> None:
        """A view kept as text, so that tables in it travel with the statement that reads it."""
        self._edit(lambda state: state["views"].__setitem__(name, text))

    def _marked(self, text: str, params: dict) -> tuple[str, datetime | None]:
        """The statement without its markers, and their instant; texts and comments hold none."""
        found, parts, at = [], [], 0
        for mark in MARKER.finditer(bare(text)):
            inner = text[mark.start(1) : mark.end(1)].strip()
            literal = INSTANT.fullmatch(inner)
            if inner.upper() == "NULL":
                raise NullInstant("temporal.as_of(NULL)")
            if literal:
                found.append(instant(literal[1]))
            elif inner.startswith(":") and inner[1:] in params:
                found.append(instant(params[inner[1:]]))
            else:
                raise NotSupported("temporal.as_of takes a literal or a bound parameter")
            parts += [text[at : mark.start()], "TRUE"]
            at = mark.end()
        if len(set(found)) > 1:
            raise NotSupported("a statement has one instant")
        return "".join([*parts, text[at:]]), found[0] if found else None

    def _refuse_writes(self, text: str, names: Iterable[str], t: datetime | None) -> None:
        plain = bare(text)
        target = re.match(r"\s*(?:WITH\b.*?\)\s*)?(INSERT\s+(?:INTO|OVERWRITE)|UPDATE|DELETE\s+FROM|MERGE\s+INTO|TRUNCATE\s+TABLE)\s+(?:TABLE\s+)?(.*)", plain, re.IGNORECASE | re.DOTALL)
        for n in names if target else ():
            if re.match(rf"{_spelled(n)}(?![\w.])", target[2], re.IGNORECASE):
                raise ReadOnlyAsOf(f"{n} can't be written while an instant is set") if t is not None else NotSupported("tracked tables are written through their table object")
            if re.match(rf"{_spelled(n + '__history')}(?![\w.])", target[2], re.IGNORECASE):
                raise NotAllowed("a history can't be written")

    def sql(self, text: str, **params) -> DataFrame:
        """A statement over tracked tables, views and whatever this Spark session knows, at the marker's instant, else the session's.

        ``WHERE temporal.as_of('2024-01-01')`` anywhere, in a view too, moves the whole
        statement.  Names of tracked tables with a namespace are written a.b.  Tracked
        tables and views that the statement names are put before it as a WITH clause, so
        that the user's temporary views, functions and settings hold; those don't see
        tracked tables themselves.
        """
        state = self._state()
        tables = [n for n, x in state["tables"].items() if x["tracked"]]
        text, t = self._marked(text, params)
        # views, and views in views, those that are read first
        views, marks = {}, {t}

        def visit(plain: str, above: tuple[str, ...]) -> None:
            for n in names_in(plain, state["views"]):
                if n in above:
                    raise TemporalError(f"the view {n} reads itself")
                if n not in views:
                    body, mark = self._marked(state["views"][n], params)
                    visit(bare(body), (*above, n))
                    views[n] = body
                    marks.add(mark)

        visit(bare(text), ())
        marks.discard(None)
        if len(marks) > 1:
            raise NotSupported("a statement has one instant")
        t = marks.pop() if marks else self.instant
        self._refuse_writes(text, tables, t)
        bodies = [text, *views.values()]
        if t is not None and any(re.search(r"\bTABLESAMPLE\b", bare(x), re.IGNORECASE) for x in bodies):
            raise NotSupported("TABLESAMPLE of the past")

        # what is read, under names that no one else has
        sources: dict[str, DataFrame] = {}
        for n in tables:
            table, shown = TemporalTable(self, n), n.replace(".", "__ns__")
            reads = {n: lambda table=table: table.current() if t is None else table.as_of(t)}
            if t is None:
                reads |= {f"{n}__history": table.history, f"{n}__versions": lambda table=table: V.versions(table.current(), table.history())}
            for name, read in reads.items():
                if any(names_in(bare(x), [name]) for x in bodies):
                    sources[name.replace(n, shown, 1)] = read()
            if "." in n:
                bodies = [self._renamed(x, n, shown) for x in bodies]
        text, views = bodies[0], dict(zip(views, bodies[1:]))
        own = f"_chronolake_{uuid.uuid4().hex}"
        relations = {n: f"SELECT * FROM {own}_{k}" for k, n in enumerate(sources)} | views
        for k, df in enumerate(sources.values()):
            df.createOrReplaceTempView(f"{own}_{k}")
        bound = {k: v for k, v in params.items() if re.search(rf":{re.escape(k)}\b", "".join(map(bare, bodies)))}
        try:
            return self.spark.sql(with_relations(text, relations), args=bound or None)
        finally:
            for k in range(len(sources)):
                self.spark.catalog.dropTempView(f"{own}_{k}")

    def _renamed(self, text: str, old: str, new: str) -> str:
        parts, at = [], 0
        for found in re.finditer(rf"(?<![\w.]){_spelled(old)}(?=(__history|__versions)?(?!\w))", bare(text), re.IGNORECASE):
            parts += [text[at : found.start()], new]
            at = found.end()
        return "".join([*parts, text[at:]])

    def clone(self, path: str) -> TemporalSession:
        """A session over a new store that begins as this one is now; data files are shared, commits aren't."""
        copied = copy.copy(self)
        copied.store, copied._tx, copied.on_commit = Store(self.spark, path), None, []
        copied.store.commit(0, self._state())
        return copied
