"""Filter interaction audit by contingency tensor contractions.

Five filters judge every text on its own; the failure pattern of a document is one of 32. Documents are counted per part and pattern, all of
them, the good and the toxic ones, so a part is a tensor of 3 x 2 x 2 x 2 x 2 x 2 counts, whatever its size. For every order of the filters and
every step, one contraction takes, along each axis, the passing, the failing or all documents: earlier filters pass, the step's filter
fails, later filters are free.

Rows meet only in counts and minima that Spark combines before the shuffle. That a text repeats a smaller doc_id's is found from one minimum per
digest, met by rows already counted per digest, part and label.

Defined results: a null text is empty, its share of capitals passes and it has no distinct words to miss; a null source is the empty
string and one part with it; a null doc_id counts as larger than any other and has no labels; several rows of one doc_id are each
counted and none is smaller than the other; several labels of one doc_id count as good or toxic if one is; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm.common import query, table
from blocklens.session import cut_lineage

FILTERS = "ABCDE"
#: fixed values: bounds of the filters
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
#: along one axis: take the documents that pass, that fail, or all
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_NOT_CAPITAL = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, A being the lowest."""
    words = text.split()
    points = len(text) - int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())
    capitals, symbols = len(text.translate(None, _NOT_CAPITAL)), len(text.translate(None, _NOT_SYMBOL))
    failed = (len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * capitals > CAPITAL_PERCENT * points, symbols > 0)
    return sum(1 << k for k, f in enumerate(failed) if f)


def _judge(batches):
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([failures(t) for t in texts], pa.int32()),
                                          pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["doc_id", "part", "failed", "digest"])


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, pattern (bits of A to E), good, toxic, n: how many documents; one row per combination met."""
    judged = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), docs["text"].alias("text")).mapInArrow(
        _judge, "doc_id long, part string, failed int, digest binary")
    flag = lambda c: F.coalesce(F.max(labels[c] == 1), F.lit(False))
    marks = labels.groupBy(labels["doc_id"].alias("doc_l")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    known = judged.join(marks, F.col("doc_id") == F.col("doc_l"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # rows of one doc_id first: the smallest id of a digest is then one row per part
    single = known.groupBy("doc_id", "digest", "part", "failed", "good", "toxic").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("null_"), F.col("doc_id").alias("id_"))
    met = cut_lineage(single.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(order.alias("at"), "n")).alias("least")))
    first = met.groupBy("digest").agg(F.min("least.at").alias("first"))
    # of each row's documents, those of the smallest id pass E and the others fail it
    passes = F.when(F.col("least.at") == F.col("first"), F.col("least.n")).otherwise(0)
    split = met.join(first, "digest").select("part", "failed", "good", "toxic", passes.alias("passes"), (F.col("n") - passes).alias("fails"))
    sums = split.groupBy("part", "failed", "good", "toxic").agg(F.sum("passes").alias("passes"), F.sum("fails").alias("fails"))
    repeat = 1 << FILTERS.index("E")
    cells = F.explode(F.array(F.struct(F.col("failed").alias("pattern"), F.col("passes").alias("n")), F.struct((F.col("failed") + repeat).alias("pattern"), F.col("fails").alias("n"))))
    return sums.select("part", "good", "toxic", cells.alias("cell")).select("part", "cell.pattern", "good", "toxic", "cell.n").filter("n > 0")


def selections(orders: list[str] = ORDERS) -> list[np.ndarray]:
    """Per axis, the choice of every (order, step): an array of choices (rows, 2) for the documents removed there."""
    taken = [[] for _ in FILTERS]
    for order in orders:
        for step, own in enumerate(order):
            for axis, name in enumerate(FILTERS):
                taken[axis].append(FAIL if name == own else PASS if name in order[:step] else ALL)
    return [np.array(t, np.int64) for t in taken]


def contract(tensor: np.ndarray, choice: list[np.ndarray]) -> np.ndarray:
    """Sums of ``tensor`` (m, 2, 2, 2, 2, 2) under every row of the axes' choices: (m, rows)."""
    return np.einsum("mabcde,ra,rb,rc,rd,re->mr", tensor, *choice, optimize=True)


_REMOVED = selections()
_OWN = np.array([FILTERS.index(f) for order in ORDERS for f in order])
#: documents that fail a filter, and those that fail it alone
_FAILS = [np.array([FAIL if axis == k else ALL for k in range(5)], np.int64) for axis in range(5)]
_ALONE = [np.array([FAIL if axis == k else PASS for k in range(5)], np.int64) for axis in range(5)]
_TOTAL = [np.array([ALL], np.int64)] * 5


def audit(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of all 600 (order, step) of one part; ``tensor`` (3, 2, 2, 2, 2, 2): all, good and toxic documents by passing or failing A to E."""
    removed, good, toxic = contract(tensor, _REMOVED)
    every = tensor[:1]
    fails, alone = contract(every, _FAILS)[0], contract(every, _ALONE)[0]
    kept = contract(every, _TOTAL)[0, 0] - np.cumsum(removed.reshape(-1, 5), axis=1).ravel()
    total = np.bincount(_OWN, weights=removed, minlength=5).astype(np.int64)
    return dict(zip(COUNTS, (kept, removed, fails[_OWN] - removed, alone[_OWN], good, toxic, total[_OWN])))


def _tensors(batches):
    rows = len(_OWN)
    for batch in batches:
        for i in range(batch.num_rows):
            flat = np.array(batch.column(1)[i].as_py(), np.int64).reshape(3, 32)
            # pattern bits count A as the lowest: the first axis of the reshaped tensor is E
            counts = audit(flat.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1))
            part = pa.array([batch.column(0)[i].as_py()] * rows, pa.string())
            orders = pa.array([o for o in ORDERS for _ in o], pa.string())
            steps = pa.array(list(range(1, 6)) * len(ORDERS), pa.int32())
            yield pa.RecordBatch.from_arrays([part, orders, steps, *[pa.array(counts[c], pa.int64()) for c in COUNTS]], names=["part", "filter_order", "step", *COUNTS])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts: 600 rows per part."""
    found = patterns(docs, labels)
    cells = [F.sum(F.when((F.col("pattern") == k) & on, F.col("n")).otherwise(0)) for on in (F.lit(True), F.col("good"), F.col("toxic")) for k in range(32)]
    tensors = found.groupBy("part").agg(F.array(*cells).alias("cells"))
    return tensors.mapInArrow(_tensors, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f)"
SQL = f"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
first AS (SELECT text, min(doc_id) AS first_id FROM w GROUP BY text),
j AS (SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * length(w.text) AS c, regexp_matches(w.text, '[#$%&*|]') AS d,
    coalesce(w.doc_id > first_id, w.doc_id IS NULL AND first_id IS NOT NULL) AS e,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic
    FROM w JOIN first USING (text)),
cells AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
    || (CASE WHEN e THEN 'E' ELSE '' END) AS failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM j GROUP BY ALL),
orders AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM {_LETTERS} p, {_LETTERS} q, {_LETTERS} r, {_LETTERS} s, {_LETTERS} t
    WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
s AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT contains(failed, own) AND (earlier = '' OR translate(failed, earlier, '') = failed) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN contains(failed, own) AND (earlier = '' OR translate(failed, earlier, '') = failed) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(failed, own) AND earlier <> '' AND translate(failed, earlier, '') <> failed THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN contains(failed, own) AND (earlier = '' OR translate(failed, earlier, '') = failed) THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN contains(failed, own) AND (earlier = '' OR translate(failed, earlier, '') = failed) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s"""


@query("op13_filter_audit", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
