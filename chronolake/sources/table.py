"""A tracked table: versioned writes, reads of any instant, maintenance, schema evolution."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TableConfig, check_excluded, check_interval
from ..errors import NotAllowed, NotNullViolation, NotSupported, StaleWriter, TemporalError, UniqueViolation
from ..operators import changes as C
from ..operators import maintain as M
from ..operators import versions as V

BUCKETS = 8
CODECS = ("zstd", "snappy", "lz4", "gzip", "none", "default")


class TemporalTable:
    def __init__(self, session, name: str):
        self.session, self.name = session, name

    # state

    @property
    def state(self) -> dict:
        return self.session.state_of(self.name)

    @property
    def config(self) -> TableConfig:
        return TableConfig.from_json(self.state["config"])

    @property
    def key(self) -> list[str]:
        return list(self.config.key)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state["schema"])

    @property
    def history_schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state["history_schema"])

    @property
    def app_columns(self) -> list[str]:
        return [c for c in self.schema.names if c not in (*V.MANAGED, V.ROW_ID)]

    def _bucket(self, names: Sequence[str | Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(names or self.key)), F.lit(self.state["buckets"])).cast("int")

    # reads

    def current(self) -> DataFrame:
        """The base table as it is at present, whatever instant is set."""
        return self.session.store.load(list(self.state["base"].values()), self.schema)

    def history(self) -> DataFrame:
        state = self.state
        return self.session.store.load([*state["tail"].values(), *state["closed"]], self.history_schema)

    def as_of(self, t: datetime) -> DataFrame:
        state = self.state
        # after the last write no closed version holds
        if state["newest_end"] is not None and _micros(t) >= state["newest_end"]:
            return self.current().filter(F.col(V.FROM) <= F.lit(t))
        return V.as_of(self.current(), self.history(), t)

    def read(self) -> DataFrame:
        """The table at the session's instant, or at present."""
        t = self.session.instant
        return self.current() if t is None else self.as_of(t)

    def versions(self) -> DataFrame:
        self.session.reject_as_of("versions")
        return V.versions(self.current(), self.history())

    def from_to(self, a, b) -> DataFrame:
        return V.from_to(self.versions(), a, b)

    def between(self, a, b) -> DataFrame:
        return V.between(self.versions(), a, b)

    def contained_in(self, a, b) -> DataFrame:
        return V.contained_in(self.versions(), a, b)

    def changes(self, start=None, end=None, pk: dict | None = None) -> DataFrame:
        self.session.reject_as_of("changes")
        return C.changes(self.versions(), self.key, start=start, end=end, match=pk, excluded=self.config.excluded, lineage=self.config.lineage)

    def column_history(self, pk: dict, column: str, until=None) -> DataFrame:
        self.session.reject_as_of("column_history")
        return C.column_history(self.versions(), self.key, column, pk, until, self.config.excluded, self.config.lineage)

    def stats(self) -> DataFrame:
        self.session.reject_as_of("table_stats")
        size = lambda paths: F.lit(self.session.store.bytes_of(paths)).cast("long")
        state = self.state
        return C.table_stats(self.current(), self.history()).withColumns({"base_bytes": size(list(state["base"].values())), "history_bytes": size([*state["tail"].values(), *state["closed"]])})

    def heatmap(self, bin_seconds: int | None = None) -> DataFrame:
        return C.heatmap(self.versions(), self.key, bin_seconds)

    # writes

    def _guard(self) -> tuple[datetime, str | None]:
        self.session.reject_write(self.name)
        user = self.session.user
        if self.session.require_user and user is None:
            raise NotAllowed("a write needs a user")
        return self.session.tx_time, user

    def _complete(self, rows: DataFrame) -> DataFrame:
        """Rows with all columns of the table, generated ones computed."""
        out = rows
        for f in self.schema:
            if f.name in self.config.generated:
                out = out.withColumn(f.name, F.expr(self.config.generated[f.name]).cast(f.dataType))
            elif f.name not in out.columns:
                out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
            else:
                out = out.withColumn(f.name, F.col(f.name).cast(f.dataType))
        return out.select(*self.schema.names)

    def _touched(self, keys: DataFrame) -> list[str]:
        """Buckets of the rows; no more than the table has."""
        return [str(r[0]) for r in keys.select(self._bucket()).distinct().collect()]

    def _live(self, side: str, buckets: Sequence[str]) -> DataFrame:
        schema = self.schema if side == "base" else self.history_schema
        return self.session.store.load([self.state[side][b] for b in buckets if b in self.state[side]], schema)

    def insert(self, rows: DataFrame, on_conflict: str = "error") -> int:
        """Stamp and add rows; on_conflict "error" or "nothing".  Returns how many."""
        tx, user = self._guard()
        new = self._stamp_rows(rows, tx, user)
        self._check_rows(new)
        known = self._live("base", self._touched(new)).select(*self.key)
        clash = new.join(known, self.key, "left_semi")
        if on_conflict == "nothing":
            new = new.join(known, self.key, "left_anti").dropDuplicates(self.key)
        elif not clash.isEmpty():
            raise UniqueViolation(f"{self.name}: the key exists")
        return self._apply(new.select(F.lit(None).cast(self.schema).alias("o"), F.struct(*self.schema.names).alias("n")))

    append = insert

    def _stamp_rows(self, rows: DataFrame, tx: datetime, user: str | None) -> DataFrame:
        full = self._complete(rows)
        if self.config.lineage:
            full = self.session.with_row_ids(self.name, full)
        return full.withColumns({V.FROM: F.lit(tx), V.BY: F.lit(user).cast("string")}).select(*self.schema.names)

    def _check_rows(self, rows: DataFrame) -> None:
        required = [*self.key, *self.state["not_null"]]
        missing = F.lit(False)
        for c in required:
            missing = missing | F.col(c).isNull()
        found = rows.agg(F.count_if(missing).alias("nulls"), F.count("*").alias("n"), F.count_distinct(F.struct(*self.key)).alias("keys")).head()
        if found.nulls:
            raise NotNullViolation(f"{self.name}: a null in {', '.join(required)}")
        if found.keys < found.n:
            raise UniqueViolation(f"{self.name}: a key occurs twice")

    def update(self, values: dict[str, Column], where: Column | None = None, source: DataFrame | None = None, on: Sequence[str] | None = None) -> int:
        """Set columns of the rows that match, with columns of a source joined on some of them (UPDATE ... FROM)."""
        self._guard()
        rows = self.current()
        if source is not None:
            rows = rows.join(source, list(on or self.key))
        if where is not None:
            rows = rows.filter(where)
        old = F.struct(*self.schema.names)
        new = self._new_image({c: values.get(c, F.col(c)) for c in self.schema.names})
        return self._apply(rows.select(old.alias("o"), new.alias("n")))

    def _new_image(self, values: dict[str, Column]) -> Column:
        kinds = {f.name: f.dataType for f in self.schema}
        return F.struct(*((F.expr(self.config.generated[c]) if c in self.config.generated else values[c]).cast(kinds[c]).alias(c) for c in self.schema.names))

    def delete(self, where: Column | None = None, source: DataFrame | None = None, on: Sequence[str] | None = None) -> int:
        """Delete the rows that match, or that join a source (DELETE ... USING)."""
        self._guard()
        rows = self.current()
        if source is not None:
            rows = rows.join(source.select(*(on or self.key)).distinct(), list(on or self.key), "left_semi")
        if where is not None:
            rows = rows.filter(where)
        return self._apply(rows.select(F.struct(*self.schema.names).alias("o"), F.lit(None).cast(self.schema).alias("n")))

    def upsert(self, rows: DataFrame, where: Column | None = None, on: Sequence[str] | None = None) -> int:
        """Insert new keys, update known ones; columns that rows lack keep their values, where limits the updates."""
        given = [c for c in rows.columns if c in self.app_columns]
        return self._merge(rows, on, update={c: F.col(f"s.{c}") for c in given}, update_when=where, insert={c: F.col(f"s.{c}") for c in given}, plain=True)

    def merge(self, source: DataFrame, on: Sequence[str] | None = None, update: dict[str, Column] | None = None, update_when: Column | None = None, delete_when: Column | None = None, insert: dict[str, Column] | None = None, insert_when: Column | None = None) -> int:
        """MERGE: matched rows are deleted, updated or left, source rows without a match inserted or left.

        Columns are named t.x for the table and s.x for the source.
        """
        return self._merge(source, on, update, update_when, delete_when, insert, insert_when)

    def _merge(self, source: DataFrame, on: Sequence[str] | None, update: dict[str, Column] | None, update_when: Column | None = None, delete_when: Column | None = None, insert: dict[str, Column] | None = None, insert_when: Column | None = None, plain: bool = False) -> int:
        """plain: inserted columns are the source's own."""
        tx, user = self._guard()
        on = list(on or self.key)
        s, t = source.alias("s"), self.current().withColumn("_t", F.lit(True)).alias("t")
        match = F.lit(True)
        for c in on:
            match = match & (F.col(f"t.{c}") == F.col(f"s.{c}"))
        both = s.join(t, match, "left")
        hit = F.col("t._t").isNotNull()
        old = F.struct(*(F.col(f"t.{c}").alias(c) for c in self.schema.names))
        kinds = {f.name: f.dataType for f in self.schema}
        changed = F.struct(*((update or {}).get(c, F.col(f"t.{c}")).cast(kinds[c]).alias(c) for c in self.schema.names))
        gone = F.lit(False) if delete_when is None else F.coalesce(delete_when, F.lit(False))
        edited = F.lit(update is not None) & (F.lit(True) if update_when is None else F.coalesce(update_when, F.lit(False)))
        ops = both.filter(hit & (gone | edited)).select(old.alias("o"), F.when(~gone, changed).alias("n"))
        if insert is not None:
            fresh = both.filter(~hit & (F.lit(True) if insert_when is None else insert_when)).select(*(v.alias(c) for c, v in insert.items()))
            new = self._stamp_rows(fresh, tx, user)
            ops = ops.unionByName(new.select(F.lit(None).cast(self.schema).alias("o"), F.struct(*self.schema.names).alias("n")))
        # a source row without a match on the key is new if the key reaches the table as it was compared
        kind = dict(source.dtypes)
        same = all(c in on and kind.get(c) == kinds[c].simpleString() and c not in self.config.generated for c in self.key)
        return self._apply(ops, matched=plain and same)

    def truncate(self) -> None:
        raise NotSupported("a tracked table can't be truncated")

    def _apply(self, ops: DataFrame, matched: bool = False) -> int:
        """Write one statement: o is the row before (null: insert), n the row after (null: delete).

        matched: no inserted key is in the table.
        """
        pins = len(self.session.pins)
        try:
            return self._write(self.session.pinned(ops), matched)
        finally:
            self.session.unpin(pins)

    def _write(self, ops: DataFrame, matched: bool) -> int:
        tx, user = self._guard()
        store, state, config, schema, past, key = self.session.store, self.state, self.config, self.schema, self.history_schema, self.key
        own = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in key]
        moved = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in key]
        delete, insert = F.col("n").isNull(), F.col("o").isNull()
        missing, elsewhere = F.lit(False), ~F.struct(*own).eqNullSafe(F.struct(*moved))
        required = [*key, *state["not_null"]]
        for c in required:
            missing = missing | F.col(f"n.{c}").isNull()
        # one pass: what is wrong with the statement, and the buckets that it touches, no more than the table has
        seen = ops.agg(
            F.count("*").alias("n"), F.count_if(insert & missing).alias("nulls"), F.count_if(F.col(f"o.{V.FROM}") > F.lit(tx)).alias("stale"), F.count_distinct(F.struct(*own)).alias("keys"),
            F.count_if(insert).alias("inserted"), F.count_if(elsewhere).alias("moved"), F.collect_set(self._bucket(own)).alias("from_b"), F.collect_set(self._bucket(moved)).alias("to_b"),
        ).head()
        if not seen.n:
            return 0
        if seen.nulls:
            raise NotNullViolation(f"{self.name}: a null in {', '.join(required)}")
        if seen.stale:
            raise StaleWriter(f"{self.name}: a row is newer than the transaction")
        if seen.keys < seen.n or (seen.moved and ops.select(*moved).distinct().count() < seen.n):
            raise UniqueViolation(f"{self.name}: a statement writes a key twice")
        touched = sorted(str(b) for b in {*seen.from_b, *seen.to_b})
        base, tail = self._live("base", touched), self._live("tail", touched)
        gone = ops.filter(~insert).select(*(F.col(f"o.{c}").alias(c) for c in key))
        kept = base.join(gone, key, "left_anti")
        if seen.moved or (seen.inserted and not matched):
            arrived = ops.filter(~delete & (insert | elsewhere)).select(*moved)
            if not arrived.join(kept.select(*key), key, "left_semi").isEmpty():
                raise UniqueViolation(f"{self.name}: the key exists")

        # each operation beside the newest closed version of its row, and those that no operation touches
        chain = tail.select(*(F.col(c).alias(f"_k_{c}") for c in key), F.struct(*past.names).alias("h"))
        on = F.lit(True)
        for c in key:
            on = on & (F.col(f"o.{c}") == F.col(f"_k_{c}"))
        rows = ops.withColumn("_op", F.lit(True)).join(chain, on, "full")
        differs = F.lit(False)
        for f in schema:
            if f.name not in (*V.MANAGED, *config.excluded):
                pick = lambda side, f=f: F.array_sort(F.map_entries(f"{side}.{f.name}")) if isinstance(f.dataType, T.MapType) else F.col(f"{side}.{f.name}")
                differs = differs | ~pick("o").eqNullSafe(pick("n"))
        since = F.col(f"o.{V.FROM}")
        near = since == F.lit(tx)
        if config.combine_interval > timedelta(0) and user is not None:
            near = near | ((F.col(f"o.{V.BY}") == F.lit(user)) & (since >= F.lit(tx - config.combine_interval)))
        linked = F.coalesce(F.col(f"h.{V.TO}") == since, F.lit(False))
        near = F.coalesce(near, F.lit(False))
        action = (
            F.when(F.col("_op").isNull(), "none").when(insert, "insert").when(delete & (since == F.lit(tx)), "vanish").when(delete, "close").when(~differs, "same")
            .when(near & linked, "extend").when(near, "slide").otherwise("close")
        )
        rows = rows.withColumn("action", action)
        did, who = F.col("action"), F.lit(user).cast("string")
        fresh = {c: F.col(f"n.{c}") for c in schema.names} | {V.FROM: F.when(did.isin("same", "slide"), since).otherwise(F.lit(tx)), V.BY: F.when(did == "same", F.col(f"o.{V.BY}")).otherwise(who)}
        before = {c: F.col(f"h.{c}") for c in past.names}
        closing = {c: F.col(f"o.{c}") for c in schema.names if c in past.names} | {V.TO: F.lit(tx), V.DELETED_BY: F.when(delete, who)}
        closes, known = did == "close", F.col("h").isNotNull()

        # one write for all sides, where columns of the same name have the same type in base and history
        alike = all(past[f.name].dataType == f.dataType for f in schema if f.name in past.names)
        written: dict[str, dict[str, str]] = {}
        for sides in [("base", "tail", "closed")] if alike else [("base",), ("tail", "closed")]:
            fields = {f.name: f.dataType for side in sides for f in (schema if side == "base" else past)}
            image = lambda side, values, fields=fields: F.struct(F.lit(side).alias("_side"), *(values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()))
            parts = {
                "base": lambda image=image: F.when(~delete, image("base", fresh)),
                "tail": lambda image=image: F.when(closes, image("tail", closing)).when(did == "extend", image("tail", before | {V.TO: F.lit(tx)})).when(known, image("tail", before)),
                "closed": lambda image=image: F.when(closes & known, image("closed", before)),
            }
            out = rows.select(F.explode(F.array_compact(F.array(*(parts[side]() for side in sides)))).alias("r")).select("r.*")
            if "base" in sides:
                out = out.unionByName(kept.select(image("base", {c: F.col(c) for c in schema.names}).alias("r")).select("r.*"))
            put = out.withColumn("_b", self._bucket()).repartition("_side", "_b").sortWithinPartitions("_side", "_b", *key, V.FROM)
            written |= store.write_sides(put, sides, config.codec)
        old = {k: {b: p for b, p in state[k].items() if b not in touched} | written[k] for k in ("base", "tail")}
        self.session.change(self.name, **old, closed=[*state["closed"], *written["closed"].values()], newest_end=max(state["newest_end"] or 0, _micros(tx)))
        return seen.n

    # maintenance

    def _rewrite_history(self, df: DataFrame) -> None:
        written = self.session.store.write(df.withColumn("_b", self._bucket()).repartition("_b").sortWithinPartitions("_b", *self.key, V.FROM), "tail", self.config.codec)
        # for each key the newest version stays in the tail
        state = self.state
        whole = self.session.store.load(list(written.values()), self.history_schema)
        newest = whole.groupBy(*self.key).agg(F.max(V.FROM).alias(V.FROM))
        tail = whole.join(newest, [*self.key, V.FROM], "left_semi")
        rest = whole.join(newest, [*self.key, V.FROM], "left_anti")
        put = lambda d, kind: self.session.store.write(d.withColumn("_b", self._bucket()).repartition("_b").sortWithinPartitions("_b", *self.key, V.FROM), kind, self.config.codec)
        self.session.change(self.name, base=state["base"], tail=put(tail, "tail"), closed=list(put(rest, "closed").values()), newest_end=state["newest_end"])

    def prune(self, cutoff: datetime) -> int:
        """Drop versions that ended before cutoff; returns how many."""
        before = self.history()
        n = before.filter(F.col(V.TO) < F.lit(cutoff)).count()
        if n:
            self._rewrite_history(M.prune(before, cutoff))
        return n

    def compact_history(self) -> int:
        """Merge neighbouring equal versions; returns how many went."""
        before = self.history()
        after = self.session.pinned(M.compact(before, self.key, self.schema.names, self.config.excluded))
        n = before.count() - after.count()
        if n:
            self._rewrite_history(after)
        return n

    def drop_history_before(self, cutoff: datetime) -> int:
        """Drop whole segments that ended before cutoff, then prune; returns the pruned rows only."""
        self.session.reject_as_of("drop_history_before")
        state = self.state
        kept = []
        for p in state["closed"]:
            if not self.session.store.load([p], self.history_schema).filter(F.col(V.TO) >= F.lit(cutoff)).isEmpty():
                kept.append(p)
        self.session.change(self.name, base=state["base"], tail=state["tail"], closed=kept, newest_end=state["newest_end"])
        return self.prune(cutoff)

    def set_history_compression(self, codec: str) -> None:
        if codec not in CODECS:
            raise TemporalError(f"unknown codec {codec}")
        self.session.configure(self.name, replace(self.config, codec="zstd" if codec == "default" else codec))

    def _version_at(self, pk: dict, t: datetime | None) -> DataFrame:
        found = self.versions()
        for c, v in pk.items():
            found = found.filter(F.col(c) == F.lit(v))
        if t is not None:
            found = V.at_instant(found, t)
        return found.orderBy(F.col(V.FROM).desc()).limit(1).select(*self.schema.names)

    def restore(self, pk: dict, t: datetime) -> int:
        """Write the row as it was at t, excluded columns too."""
        self.session.reject_as_of("restore")
        found = self.session.pinned(self._version_at(pk, t))
        if found.isEmpty():
            raise TemporalError(f"{self.name}: no version of {pk} at {t}")
        return self.upsert(found.select(*self.app_columns, *([V.ROW_ID] if self.config.lineage else [])))

    def restore_deleted(self, pk: dict) -> int:
        """Insert the last version of a deleted row again, with its row id."""
        self.session.reject_as_of("restore_deleted")
        present = self.current()
        for c, v in pk.items():
            present = present.filter(F.col(c) == F.lit(v))
        if not present.isEmpty():
            raise TemporalError(f"{self.name}: {pk} is not deleted")
        found = self.session.pinned(self._version_at(pk, None))
        if found.isEmpty():
            raise TemporalError(f"{self.name}: no version of {pk}")
        return self.insert(found.drop(*V.MANAGED))

    # settings and schema

    def set_excluded_columns(self, names: Sequence[str]) -> None:
        check_excluded(names, self.key, self.schema)
        self.session.configure(self.name, replace(self.config, excluded=tuple(names)))

    def set_combine_interval(self, interval: timedelta) -> None:
        check_interval(interval)
        self.session.configure(self.name, replace(self.config, combine_interval=interval))

    def set_include_indexes(self, on: bool) -> None:
        self.session.configure(self.name, replace(self.config, include_indexes=on))

    def _refuse_managed(self, *names: str) -> None:
        for c in names:
            if c in (*V.ALL_MANAGED, V.ROW_ID):
                raise TemporalError(f"{c} is managed")

    def _rewrite(self, change: Callable[[DataFrame], DataFrame], config: TableConfig | None = None) -> None:
        """All rows through change, base and history alike."""
        if config:
            self.session.configure(self.name, config)
        sides = {}
        history = None
        for side in ("base", "tail", "closed"):
            state = self.state
            paths = list(state[side].values()) if side != "closed" else state[side]
            df = change(self.session.store.load(paths, self.schema if side == "base" else self.history_schema))
            history = df.schema if side != "base" else history
            sides[side] = (df, self.session.store.write(df.withColumn("_b", F.pmod(F.xxhash64(*(config or self.config).key), F.lit(state["buckets"])).cast("int")).repartition("_b"), side, self.config.codec))
        self.session.change(self.name, base=sides["base"][1], tail=sides["tail"][1], closed=list(sides["closed"][1].values()), newest_end=self.state["newest_end"], schema=sides["base"][0].schema.jsonValue(), history_schema=history.jsonValue())

    def add_column(self, name: str, kind: str, default=None) -> None:
        """A new column; rows of the history have null for it, present rows the default."""
        self._refuse_managed(name)
        if name in self.history_schema.names:
            raise TemporalError(f"{name} is a column of the history")
        field = T.StructType.fromDDL(f"`{name}` {kind}")[0]
        state = self.state
        schema, history = T.StructType([*self.schema, field]), T.StructType([*self.history_schema, field])
        base = state["base"]
        if default is not None:
            df = self.current().withColumn(name, F.lit(default).cast(field.dataType)).withColumn("_b", self._bucket())
            base = self.session.store.write(df.repartition("_b"), "base", self.config.codec)
        self.session.change(self.name, base=base, tail=state["tail"], closed=state["closed"], newest_end=state["newest_end"], schema=schema.jsonValue(), history_schema=history.jsonValue())

    def rename_column(self, old: str, new: str) -> None:
        self._refuse_managed(old, new)
        if old not in self.schema.names or new in self.history_schema.names:
            raise TemporalError(f"can't rename {old} to {new}")
        to = lambda names: tuple(new if c == old else c for c in names)
        config = replace(self.config, key=to(self.config.key), excluded=to(self.config.excluded))
        self._rewrite(lambda df: df.withColumnRenamed(old, new), config)

    def drop_column(self, name: str, drop_from_history: bool = False, compact: bool = False) -> None:
        """Drop a column of the base; the history keeps it unless told otherwise."""
        self._refuse_managed(name)
        if name in self.key or name not in self.schema.names:
            raise TemporalError(f"can't drop {name}")
        state = self.state
        schema = T.StructType([f for f in self.schema if f.name != name])
        history = T.StructType([f for f in self.history_schema if f.name != name]) if drop_from_history else self.history_schema
        self.session.change(self.name, base=state["base"], tail=state["tail"], closed=state["closed"], newest_end=state["newest_end"], schema=schema.jsonValue(), history_schema=history.jsonValue())
        self.session.configure(self.name, replace(self.config, excluded=tuple(c for c in self.config.excluded if c != name)))
        if compact:
            self.compact_history()

    def alter_column_type(self, name: str, kind: str, using: str | None = None) -> None:
        self._refuse_managed(name)
        if name not in self.schema.names:
            raise TemporalError(f"no column {name}")
        self._rewrite(lambda df: df.withColumn(name, (F.expr(using) if using else F.col(name)).cast(kind)))


def _micros(t: datetime) -> int:
    return int(t.timestamp()) * 1_000_000 + t.microsecond
