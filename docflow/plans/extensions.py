"""Extension points: named metrics, page steps, extractors and models from outside.

A model or extractor is any function over Arrow batches; tests and queries use
deterministic stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from docflow.operators.scratch import written

Step = Callable[[DataFrame], DataFrame]


class Registry:
    """Callables by name, with a description; unknown names are told with the known ones."""

    def __init__(self) -> None:
        self._entries: dict[str, tuple[Callable, str]] = {}

    def add(self, name: str, about: str = "") -> Callable[[Callable], Callable]:
        def put(fn: Callable) -> Callable:
            if name in self._entries:
                raise ValueError(f"{name!r} is registered already")
            self._entries[name] = (fn, about or (fn.__doc__ or "").strip().split("\n")[0])
            return fn

        return put

    def get(self, name: str) -> Callable:
        if name not in self._entries:
            import difflib

            near = difflib.get_close_matches(name, self._entries, 3)
            raise KeyError(f"unknown {name!r}" + (f"; did you mean {', '.join(near)}?" if near else f"; known: {', '.join(sorted(self._entries))}"))
        return self._entries[name][0]

    def names(self) -> dict[str, str]:
        return {k: about for k, (_, about) in sorted(self._entries.items())}


METRICS = Registry()
REWARDS = Registry()


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    """Steps in a row; a step drops rows by filtering them."""
    for step in steps:
        df = df.transform(step)
    return df


def parse_spec(spec: str) -> tuple[str, dict[str, str]]:
    """``name:option=value:option=value`` as a name and options."""
    name, *options = spec.split(":")
    bad = [o for o in options if "=" not in o]
    if bad or not name:
        raise ValueError(f"bad extractor {spec!r}")
    return name, dict(o.split("=", 1) for o in options)


def call_model(rows: DataFrame, request: Column, make_client: Callable[[], Callable[[str, float], str | None]], attempts: int = 8, temperatures: tuple[float, ...] = (0.1, 0.1, 0.2, 0.3, 0.5, 0.8, 0.9, 1.0)) -> DataFrame:
    """``rows`` with reply, attempt and is_fallback from a client that each worker makes once.

    A client that gives None or raises ValueError is asked again, hotter; when all
    attempts are used up the reply is null and the page is a fallback.
    """
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            replies, used = [], []
            for text in batch.column(batch.schema.get_field_index("__request")).to_pylist():
                reply, k = None, 0
                for k in range(attempts):
                    try:
                        reply = client(text, temperatures[min(k, len(temperatures) - 1)])
                    except ValueError:
                        reply = None
                    if reply is not None:
                        break
                replies.append(reply)
                used.append(k)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(replies, pa.string()), pa.array(used, pa.int32()), pa.array([r is None for r in replies], pa.bool_())], [*kept, "reply", "attempt", "is_fallback"])

    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", reply string, attempt int, is_fallback boolean"
    return rows.withColumn("__request", request.cast("string")).mapInArrow(run, schema)


@METRICS.add("formula", "characters of formulas that agree")
def formula(pairs: DataFrame) -> DataFrame:
    from docflow.functions.text import extract_formulas

    z = F.zip_with(extract_formulas(F.col("pred")), extract_formulas(F.col("target")), lambda p, g: F.struct(F.coalesce(p, F.lit("")).alias("p"), F.coalesce(g, F.lit("")).alias("g")))
    rows = pairs.select("rel", z.alias("z"))
    total = F.aggregate("z", F.lit(0), lambda acc, x: acc + F.length(x["g"]))
    got = F.aggregate("z", F.lit(0), lambda acc, x: acc + F.greatest(F.length(x["g"]) - F.levenshtein(x["p"], x["g"]), F.lit(0)))
    return rows.select("rel", F.when(total > 0, got / total).otherwise(1.0).alias("formula_cdm"))


def _python_metric(fn: Callable, prepare: Callable[[Column], Column], names: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """A metric of values that ``prepare`` takes from both texts, scored one by one in Python."""
    from pyspark.sql import types as T

    from docflow.functions.fuzzy import row_udf

    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    def run(pairs: DataFrame) -> DataFrame:
        score = row_udf(fn, kind)(pred=prepare(F.col("pred")), target=prepare(F.col("target")))
        return pairs.select("rel", score.alias("s")).select("rel", *[F.col(f"s.{n}").alias(n) for n in names])

    run.parts = fn, prepare, kind
    return run


def _parts_of(name: str) -> tuple[Callable, Callable[[Column], Column], DataType] | None:
    """What a metric of :func:`_python_metric` scores, how it prepares a text and what it gives; none for others."""
    return getattr(METRICS.get(name)(None), "parts", None) if METRICS.get(name) in _SCORED else None


def _scored_at_once(pairs: DataFrame, parts: dict) -> DataFrame:
    """``pairs`` with a column ``__scores``: a struct of what each metric gives, from one call of Python a batch."""
    from pyspark.sql import types as T

    from docflow.functions.fuzzy import row_udf

    scores = {n: fn for n, (fn, _, _) in parts.items()}

    def run(pred: dict, target: dict) -> dict:
        return {n: fn(pred=pred[n], target=target[n]) for n, fn in scores.items()}

    side = lambda c: F.struct(*[prepare(F.col(c)).alias(n) for n, (_, prepare, _) in parts.items()])
    kind = T.StructType([T.StructField(n, k) for n, (_, _, k) in parts.items()])
    return pairs.select("*", row_udf(run, kind)(pred=side("pred"), target=side("target")).alias("__scores"))


def _distance_metric(prepare: Callable[[Column], Column], distance: str, similarity: str) -> Callable[[DataFrame], DataFrame]:
    """The edit distance of prepared texts over the longer one, and what it lacks of 1.

    Prepared texts stand once in the plan: as a native distance needs them many times, Spark takes longer to plan than to run.
    """
    from docflow.functions import fuzzy

    def score(pred: str | None, target: str | None) -> dict:
        d = fuzzy.normalized_distance(pred, target)
        return {} if d is None else {distance: d, similarity: 1 - d}

    return _python_metric(score, prepare, (distance, similarity))


@METRICS.add("text_edit", "mean edit distance over the longer text")
def text_edit(pairs: DataFrame) -> DataFrame:
    from docflow.functions.text import prepare_for_text_edit

    metric = _distance_metric(prepare_for_text_edit, "text_edit", "text_edit_sim")
    return metric if pairs is None else metric(pairs)


@METRICS.add("reading_order", "distance of the texts with lines trimmed")
def reading_order(pairs: DataFrame) -> DataFrame:
    trimmed = lambda c: F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    metric = _distance_metric(trimmed, "reading_order_ned", "reading_order")
    return metric if pairs is None else metric(pairs)


@METRICS.add("headings", "precision and recall of headings, by text and by level")
def headings(pairs: DataFrame) -> DataFrame:
    from docflow.functions import fuzzy, text

    metric = _python_metric(lambda pred, target: fuzzy.heading_scores(pred, target), text.extract_headings, ("text_p", "text_r", "level_p", "level_r"))
    return metric if pairs is None else metric(pairs)


@METRICS.add("table_trees", "tree similarity of tables, with and without their texts")
def table_trees(pairs: DataFrame) -> DataFrame:
    from docflow.functions import tables, text

    metric = _python_metric(lambda pred, target: tables.table_scores(pred, target), text.extract_tables, ("teds_structure", "teds_text"))
    return metric if pairs is None else metric(pairs)


@METRICS.add("table_cells", "precision, recall and similarity of matched table cells")
def table_cells(pairs: DataFrame) -> DataFrame:
    from docflow.functions import tables, text

    metric = _python_metric(lambda pred, target: tables.table_f1(pred, target) or {}, text.extract_tables, ("p", "r", "f1", "avg_sim"))
    return metric if pairs is None else metric(pairs)


@METRICS.add("code_trees", "tree similarity of fenced code")
def code_trees(pairs: DataFrame) -> DataFrame:
    from docflow.functions import fuzzy

    metric = _python_metric(lambda pred, target: {"code_ted": fuzzy.tree_similarity(fuzzy.code_tree(pred or ""), fuzzy.code_tree(target or ""))}, lambda x: x, ("code_ted",))
    return metric if pairs is None else metric(pairs)


_RECORD = (
    "heading_structure_p double, heading_structure_r double, heading_structure_f1 double, level_p double, level_r double, level_f1 double, list_p double, list_r double, list_f1 double, "
    "text_edit double, text_edit_sim double, paragraph_pairs long, contents_sim double, has_heading_gt boolean, has_list_gt boolean"
)


def _text_record(pred: dict, target: dict) -> dict | None:
    """What the text metrics say of one pair of prepared pages; none where neither has text."""
    from docflow.functions import fuzzy

    if not pred["text"].strip() and not target["text"].strip():
        return None
    f1 = lambda p, r: None if p is None or r is None else 2 * p * r / (p + r) if p + r else 0.0
    heads = fuzzy.heading_scores(pred["headings"], target["headings"])
    as_heads = lambda side: [{"text": x, "level": 1} for x in side["lists"]]
    lists = fuzzy.heading_scores(as_heads(pred), as_heads(target))
    distance, pairs = fuzzy.adjacency_distance(pred["paragraphs"], target["paragraphs"])
    flat = ["\n\n".join(x["paragraphs"]) for x in (pred, target)]
    same = 1.0 if not any(x.strip() for x in flat) else 0.0 if not all(x.strip() for x in flat) else fuzzy.document_similarity(flat[1], flat[0])
    return {
        "heading_structure_p": heads["text_p"], "heading_structure_r": heads["text_r"], "heading_structure_f1": f1(heads["text_p"], heads["text_r"]), "level_p": heads["level_p"], "level_r": heads["level_r"], "level_f1": f1(heads["level_p"], heads["level_r"]),
        "list_p": lists["text_p"], "list_r": lists["text_r"], "list_f1": f1(lists["text_p"], lists["text_r"]), "text_edit": distance, "text_edit_sim": max(0.0, 1 - distance), "paragraph_pairs": pairs, "contents_sim": same,
        "has_heading_gt": bool(target["headings"]), "has_list_gt": bool(target["lists"]),
    }


def text_records(pairs: DataFrame) -> DataFrame:
    """(rel, ...): the record of text metrics of each pair (rel, pred, target); pairs without any text give none.

    Pages are prepared as columns (images and tables go before headings and lists are taken), then scored
    in one pass.  Null pages are empty.
    """
    from docflow.functions import text as X

    def prepared(name: str) -> Column:
        raw = F.coalesce(F.col(name), F.lit(""))
        bare = X.remove_tables(X.remove_images(raw), "1.9")
        own = X.prepare_for_text_edit(raw, "1.9")
        return F.struct(X.extract_headings(bare).alias("headings"), X.extract_lists(bare).alias("lists"), own.alias("text"), X.split_paragraphs(own).alias("paragraphs"))

    schema = pairs.select("rel").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_text_record(p, g) for p, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            keep = [k for k, x in enumerate(found) if x is not None]
            names = [x.split()[0] for x in _RECORD.split(", ")]
            kinds = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
            columns = [pa.array([found[k][n] for k in keep], kinds[x.split()[1]]) for n, x in zip(names, _RECORD.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *columns], ["rel", *names])

    return pairs.select("rel", prepared("pred").alias("pred"), prepared("target").alias("target")).mapInArrow(run, f"rel {schema['rel'].dataType.simpleString()}, {_RECORD}")


def f1_report(records: DataFrame) -> DataFrame:
    """The heading and list columns of text records."""
    return records.select("rel", *[f"{k}_{m}" for k in ("heading_structure", "level", "list") for m in ("p", "r", "f1")])


def box_scores(pred: list[list[float]], target: list[list[float]]) -> dict:
    """Mean overlap of target boxes [x, y, w, h] with the free box that overlaps each most, and how many found one."""

    def overlap(a: list[float], b: list[float]) -> float:
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        inter = max(0.0, w) * max(0.0, h)
        return inter / (a[2] * a[3] + b[2] * b[3] - inter) if inter else 0.0

    free, total = list(range(len(pred))), 0.0
    for b in target:
        best = max(((overlap(pred[k], b), -k) for k in free), default=None)
        if best and best[0] > 0:
            free.remove(-best[1])
            total += best[0]
    return {"iou": total / len(target) if target else None, "pairs": float(len(pred) - len(free))}


@METRICS.add("image_boxes", "overlap of the boxes that image comments name")
def image_boxes(pairs: DataFrame) -> DataFrame:
    from docflow.functions import text

    metric = _python_metric(box_scores, text.extract_image_boxes, ("iou", "pairs"))
    return metric if pairs is None else metric(pairs)


_SCORED = {headings, table_trees, table_cells, code_trees, image_boxes, text_edit, reading_order}


def evaluate(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics of each pair (rel, pred, target) side by side, under a first row of averages.

    A metric gets what is known of a pair so far as its ``rel`` and gives it back beside its values,
    so all are columns of one pass and every pair stays one row, also where ``rel`` is null or
    repeats.  A metric of a null text is what the metric makes of it.
    """
    parts = {name: p for name in metrics if (p := _parts_of(name))}
    out, values = pairs.select("rel", "pred", "target"), []
    for name in metrics:
        if name in parts:
            values.append([F.col("__scores")[name][n].alias(n) for n in parts[name][2].names])
            continue
        known = F.struct(*[F.col(c) for c in out.columns])
        found = METRICS.get(name)(out.select(known.alias("rel"), "pred", "target"))
        values.append([c for c in found.columns if c != "rel"])
        out = found.select("rel.*", *values[-1])
    # Metrics in Python come last and at once: one by one, Spark takes longer to plan them than to run them.
    out = _scored_at_once(out, parts) if parts else out
    out = out.select("rel", *[c for own in values for c in own])
    values = out.columns[1:]
    out = written(out.select("rel", *values), "evaluation")
    average = out.agg(*[F.avg(c).alias(c) for c in values]).withColumn("rel", F.lit("average"))
    return average.unionByName(out).select("rel", *[F.round(c, 4).alias(c) for c in values])
