"""Running suites.

Checks over the same rows (dataset, filters, window) share one scan: everything
that is a plain aggregate becomes ONE `agg`. Key-grouped and join checks keep
their own plan. All results are one lazy DataFrame.
"""

from __future__ import annotations

import datetime as dt
import re
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from ..functions.predicates import apply_filters, apply_window
from ..functions.times import moment
from ..operators.payload import with_parsed
from ..operators.privacy import redact
from ..sources.local import local_frame
from ..spec import RESULT_SCHEMA, Check, DatasetMeta, Suite
from ..verdict import Measurement, RunContext, analyse, evaluate, union_all
from .budget import severity_rank
from .registry import Env, measurement_of, violating_rows

Tables = Mapping[str, DataFrame]

OUT_OF_TIME = "time budget used up"


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _plain_row(check: Check, ctx: RunContext, status: str, message: str | None) -> tuple:
    return (
        ctx.run_id,
        ctx.suite,
        check.name,
        check.type,
        check.dataset,
        check.severity,
        check.gate,
        status,
        None,
        None,
        None,
        None,
        None,
        message,
    )


def _plain_frame(spark: SparkSession, ctx: RunContext, rows: Sequence[tuple]) -> DataFrame:
    """Rows of checks that did not run (skipped or not plannable)."""
    fields = RESULT_SCHEMA.fields[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return local_frame(spark, rows, schema).withColumn("as_of", moment(ctx.as_of))


@dataclass
class Planned:
    """Result frames with the checks they answer, and checks that do not run."""

    groups: list[tuple[list[tuple[Check, Measurement]], DataFrame]]
    not_run: list[tuple[Check, str, str | None]]


_PLAN_ERRORS = (PySparkException, ValueError, KeyError, TypeError, AttributeError)


def base_frame(check: Check, env: Env) -> DataFrame:
    df = env.table(check.dataset)
    meta = env.meta(check.dataset)
    window = check.window
    if check.type == "freshness" and window is not None and window.last_hours:
        window = None  # the window is the allowed lag, not a row filter
    df = apply_filters(df, check.filters)
    watermark = check.params.get("watermark") or meta.watermark_column
    batch = check.params.get("batch") or meta.batch_column
    df = apply_window(df, window, watermark, batch, env.as_of)
    if check.type.startswith("json_") or any(k.startswith("$") for k in check.keys):
        name = check.params.get("payload", "payload")
        if name in df.columns:
            df = with_parsed(df, name)
    return df


def gated(check: Check) -> Check:
    """`on_unknown` of a version check is its gate: fail or warn."""
    gate = check.params.get("on_unknown") if check.type == "json_version" else None
    return check if gate is None else replace(check, gate=gate)


def _rows_key(check: Check, env: Env) -> tuple:
    """Checks with equal keys look at the same rows."""
    json = check.type.startswith("json_") or any(k.startswith("$") for k in check.keys)
    window = check.window
    if check.type == "freshness" and window is not None and window.last_hours:
        window = None
    return (
        check.dataset,
        repr(check.filters),
        repr(window),
        check.params.get("watermark") if window else None,
        check.params.get("batch") if window else None,
        check.params.get("payload", "payload") if json else None,
    )


def plan_suite(
    suite: Suite,
    env: Env,
    ctx: RunContext,
    names: Sequence[str] | None = None,
    fuse: bool = True,
) -> Planned:
    """Measurements over one frame go into one aggregate. If that does not
    resolve, its checks are analysed one by one, so that a broken check becomes
    an error row and the others still share their scan."""
    bases: dict[tuple, DataFrame] = {}
    fused: dict[int, list[tuple[Check, Measurement]]] = {}
    groups: list[list[tuple[Check, Measurement]]] = []
    not_run: list[tuple[Check, str, str | None]] = []
    for check in map(gated, suite.tests):
        if not check.enabled:
            not_run.append((check, "skip", "disabled"))
            continue
        if names is not None and check.name not in names:
            not_run.append((check, "skip", "not selected"))
            continue
        try:
            key = _rows_key(check, env)
            if key not in bases:
                bases[key] = base_frame(check, env)
            base = bases[key]
            m = measurement_of(base, check, env)
        except _PLAN_ERRORS as e:
            not_run.append((check, "error", _message(e)))
            continue
        if fuse and m.frame is base:
            if id(base) not in fused:
                fused[id(base)] = []
                groups.append(fused[id(base)])
            fused[id(base)].append((check, m))
        else:
            groups.append([(check, m)])
    planned = Planned([], not_run)
    for group in groups:
        try:
            planned.groups.append((group, evaluate(group, ctx)))
        except _PLAN_ERRORS:
            good = []
            for check, m in group:
                try:
                    analyse(m)
                    good.append((check, m))
                except _PLAN_ERRORS as e:
                    not_run.append((check, "error", _message(e)))
            if good:
                planned.groups.append((good, evaluate(good, ctx)))
    return planned


def _message(e: Exception) -> str:
    return str(e.args[0] if isinstance(e, KeyError) and e.args else e).split("\n")[0]


def _context(suite: Suite, run_id: str | None, as_of: Any) -> RunContext:
    return RunContext(run_id or str(uuid.uuid4()), suite.name, as_of)


def run_suite(
    spark: SparkSession,
    suite: Suite,
    tables: Tables,
    as_of: Any = None,
    run_id: str | None = None,
    metas: Mapping[str, DatasetMeta] | None = None,
    names: Sequence[str] | None = None,
    fuse: bool = True,
) -> DataFrame:
    """All checks of a suite as one lazy DataFrame of results."""
    as_of = as_of or now()
    env = Env(tables, metas or {}, as_of)
    ctx = _context(suite, run_id, as_of)
    planned = plan_suite(suite, env, ctx, names, fuse)
    frames = [frame for _, frame in planned.groups]
    if planned.not_run:
        frames.append(_plain_frame(spark, ctx, [_plain_row(c, ctx, s, m) for c, s, m in planned.not_run]))
    return union_all(frames)


def run_check(
    spark: SparkSession,
    check: Check,
    tables: Tables,
    as_of: Any = None,
    metas: Mapping[str, DatasetMeta] | None = None,
) -> DataFrame:
    return run_suite(spark, Suite("adhoc", [check]), tables, as_of, "adhoc", metas)


def validate_suite(
    spark: SparkSession,
    suite: Suite,
    tables: Tables,
    as_of: Any = None,
    metas: Mapping[str, DatasetMeta] | None = None,
) -> DataFrame:
    """Dry run: analyse every check, run none. (test, type, dataset, valid, message)"""
    as_of = as_of or now()
    env = Env(tables, metas or {}, as_of)
    planned = plan_suite(suite, env, _context(suite, "dry-run", as_of))
    rows = [(c.name, c.type, c.dataset, True, None) for g, _ in planned.groups for c, _ in g]
    rows += [(c.name, c.type, c.dataset, s == "skip", m) for c, s, m in planned.not_run]
    return local_frame(
        spark, rows, "test string, type string, dataset string, valid boolean, message string"
    )


def _run_group(
    group: list[tuple[Check, Measurement]], frame: DataFrame, ctx: RunContext
) -> Iterator[tuple]:
    """Results of one group; a group that fails while running is run check by
    check, so that only the broken one is an error."""
    started = time.time()
    try:
        rows = frame.collect()
    except PySparkException as e:
        if len(group) == 1:
            check = group[0][0]
            row = _plain_row(check, ctx, "error", _message(e))
            yield (*row, ctx.as_of, int((time.time() - started) * 1000))
            return
        for item in group:
            yield from _run_group([item], evaluate([item], ctx), ctx)
        return
    ms = int((time.time() - started) * 1000)
    for r in rows:
        yield (*r, ms)


def execute_suite(
    spark: SparkSession,
    suite: Suite,
    tables: Tables,
    as_of: Any = None,
    run_id: str | None = None,
    metas: Mapping[str, DatasetMeta] | None = None,
    names: Sequence[str] | None = None,
    budget_seconds: float | None = None,
) -> DataFrame:
    """Run now. One row per check comes back to the driver, never data rows.

    Groups with the most severe checks run first; once the time budget is used
    up the rest is skipped. Jobs carry the tag `tablecheck-<run_id>`, so
    `spark.interruptTag` cancels a run.
    """
    as_of = now() if as_of is None else as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    env = Env(tables, metas or {}, as_of)
    ctx = _context(suite, run_id, as_of)
    planned = plan_suite(suite, env, ctx, names)
    order = {"blocker": 0, "major": 1, "minor": 2}
    groups = sorted(planned.groups, key=lambda g: min(order[c.severity] for c, _ in g[0]))
    out = [
        (*_plain_row(c, ctx, s, m), ctx.as_of, 0) for c, s, m in planned.not_run
    ]
    tag = f"tablecheck-{ctx.run_id}"
    spark.addTag(tag)
    started = time.time()
    try:
        for group, frame in groups:
            if budget_seconds is not None and time.time() - started > budget_seconds:
                out += [
                    (*_plain_row(c, ctx, "skip", OUT_OF_TIME), ctx.as_of, 0) for c, _ in group
                ]
                continue
            out += list(_run_group(group, frame, ctx))
    finally:
        spark.removeTag(tag)
    schema = StructType([*RESULT_SCHEMA.fields, StructField("duration_ms", LongType())])
    return local_frame(spark, out, schema)


# --------------------------------------------------------------------- samples


def _least(rows: DataFrame, limit: int) -> DataFrame:
    """The `limit` first rows in the order of their JSON text.

    Where the first column is a whole number, the text up to its value settles nearly every
    comparison; the whole text, the second in the order, is then made only for rows that
    are equal so far.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    first, *others = rows.schema.fields
    if not others or not isinstance(first.dataType, IntegralType) or not re.fullmatch(r"\w+", first.name, re.ASCII):
        return rows.orderBy(text).limit(limit)
    more = F.coalesce(*[F.when(F.col(f"`{f.name}`").isNotNull(), True) for f in others])
    head = F.when(more, F.concat(F.lit(f'{{"{first.name}":'), F.col(first.name).cast("string"), F.lit(",")))
    return rows.orderBy(F.coalesce(head, text), text).limit(limit)


def sample_violations(
    spark: SparkSession,
    suite: Suite,
    results: DataFrame,
    tables: Tables,
    metas: Mapping[str, DatasetMeta] | None = None,
    as_of: Any = None,
    limit: int = 100,
    strategy: str = "mask",
) -> DataFrame:
    """Masked rows of failing checks: (_test, row as JSON), at most `limit` each.

    Counts were taken before and are not limited. Per check every task keeps the
    `limit` smallest rows and those are merged, so a check with billions of violations
    collects them nowhere. Rows are ordered by what they hold and masked after that, so
    only the rows that are shown pay for the masking.
    """
    env = Env(tables, metas or {}, as_of or now())
    failing = {r.test for r in results.filter(F.col("status") == "fail").select("test").collect()}
    frames = []
    for check in suite.tests:
        if check.name not in failing:
            continue
        rows = violating_rows(base_frame(check, env), check, env)
        if rows is None:
            continue
        rows = rows.drop(*[c for c in rows.columns if c.startswith("_v_")])
        frames.append(
            redact(_least(rows, limit), strategy).select(F.lit(check.name).alias("_test"), F.to_json(F.struct("*")).alias("row"))
        )
    if not frames:
        return local_frame(spark, [], "_test string, row string")
    return union_all(frames)


# ------------------------------------------------------------- gate and summary


def gate(results: DataFrame) -> DataFrame:
    """Suite verdict per run: a failing or erroneous check with gate `fail` fails
    it, failing `warn` checks only warn; `worst` is the gravest severity that
    failed. Checks that the time budget left out make the verdict "incomplete"
    unless something fails; other skipped checks do not count."""
    bad = F.col("status").isin("fail", "error")
    stops = bad & (F.col("gate") == "fail")
    warns = bad & (F.col("gate") == "warn")
    worst = F.min(F.when(bad, severity_rank(F.col("severity"))))
    told = "error_message" in results.columns
    left_out = (F.col("status") == "skip") & (F.col("error_message") == OUT_OF_TIME) if told else F.lit(False)
    return (
        results.groupBy("run_id", "suite")
        .agg(
            F.count_if(stops).alias("failures"),
            F.count_if(warns).alias("warnings"),
            F.count_if(left_out).alias("_left_out"),
            worst.alias("_worst"),
        )
        .select(
            "run_id",
            "suite",
            F.when(F.col("failures") > 0, "fail")
            .when(F.col("_left_out") > 0, "incomplete")
            .when(F.col("warnings") > 0, "warn")
            .otherwise("pass")
            .alias("verdict"),
            "failures",
            "warnings",
            F.when(F.col("_worst") == 1, "blocker")
            .when(F.col("_worst") == 2, "major")
            .when(F.col("_worst") == 3, "minor")
            .alias("worst"),
        )
    )


def run_summary(
    results: DataFrame, started_at: Any = None, ended_at: Any = None,
    environment: str = "dev", connection: str = "spark",
) -> DataFrame:
    """Totals per run. With errors the run still completed; it failed only when
    nothing could be checked."""
    def n(status: str):
        return F.count_if(F.col("status") == status)

    start = moment(started_at) if started_at is not None else F.min("as_of")
    end = moment(ended_at) if ended_at is not None else F.max("as_of")
    from ..functions.times import epoch_micros

    out = results.groupBy("run_id", F.col("suite").alias("suite_name")).agg(
        F.count(F.lit(1)).alias("total_tests"),
        n("pass").alias("passed_tests"),
        n("fail").alias("failed_tests"),
        n("error").alias("error_tests"),
        n("skip").alias("skipped_tests"),
        F.first(start).alias("started_at") if started_at is not None else start.alias("started_at"),
        F.first(end).alias("ended_at") if ended_at is not None else end.alias("ended_at"),
    )
    ran = F.col("total_tests") - F.col("skipped_tests")
    return out.select(
        "run_id",
        "suite_name",
        F.when((ran > 0) & (F.col("error_tests") == ran), "failed").otherwise("completed").alias("status"),
        "total_tests",
        "passed_tests",
        "failed_tests",
        "error_tests",
        "skipped_tests",
        "started_at",
        "ended_at",
        F.floor((epoch_micros(F.col("ended_at")) - epoch_micros(F.col("started_at"))) / 1000).alias("execution_time_ms"),
        F.lit(environment).alias("environment"),
        F.lit(connection).alias("connection"),
    )
