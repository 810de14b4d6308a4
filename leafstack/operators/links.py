"""Grouping documents that share reference numbers into shipments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.operators.fieldset import diff_value, last_per_name
from leafstack.rules import REFERENCE_FIELDS, TERMINAL_STATES
from leafstack.session import Scratch, stored


def document_keys(fields: DataFrame, names: Sequence[str] = REFERENCE_FIELDS) -> DataFrame:
    """Reference keys of each document: document_id, key, rank (priority, from 0).

    Values are trimmed, empty ones dropped, a repeated key keeps its best rank.
    """
    rank = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    named = last_per_name(fields.filter(F.col("field_name").isin(list(names))), F.trim(diff_value()), "key")
    rows = named.select("document_id", F.try_element_at(rank, F.col("field_name")).alias("rank"), "key")
    return rows.filter(F.coalesce("key", F.lit("")) != "").groupBy("document_id", "key").agg(F.min("rank").alias("rank"))


def reference_key(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """Primary key of every document: its best key, else 'unkeyed:<id>'."""
    best = keys.groupBy("document_id").agg(F.min(F.struct("rank", "key")).alias("b"))
    return docs.select("document_id").join(best, "document_id", "left").select(
        "document_id", F.coalesce(F.col("b.key"), F.concat(F.lit("unkeyed:"), F.col("document_id"))).alias("reference_key"))


def link_to_shipments(keys: DataFrame, shipments: DataFrame, shipment_keys: DataFrame) -> DataFrame:
    """Each document's existing shipment, if any: document_id, shipment_id, key, primary_hit.

    Keys are tried in priority order; a shipment whose reference key it is comes before
    one that merely contains it, then the earliest (created_at, shipment_id).
    `shipments`: shipment_id, reference_key, created_at; `shipment_keys`: shipment_id, key.

    The owners of a key are reduced to one row first, so the join is many-to-one however
    many shipments hold a common key.
    """
    order = F.struct("created_at", "shipment_id")
    primary = shipments.select(F.col("reference_key").alias("key"), F.struct(F.lit(0).alias("kind"), order.alias("o")).alias("own"))
    holding = shipment_keys.select("shipment_id", "key").join(shipments.select("shipment_id", "created_at"), "shipment_id").select(
        "key", F.struct(F.lit(1).alias("kind"), order.alias("o")).alias("own"))
    owners = stored(primary.unionByName(holding).groupBy("key").agg(F.min("own").alias("own")), "key-owners")
    best = keys.join(owners, "key").groupBy("document_id").agg(F.min(F.struct("rank", "key", "own")).alias("b"))
    return best.select(
        "document_id", F.col("b.own.o.shipment_id").alias("shipment_id"), F.col("b.key").alias("key"),
        (F.col("b.own.kind") == 0).alias("primary_hit"))


def _numbered(rows: DataFrame, *keep: str) -> DataFrame:
    """`keep` and n: numbers in the order of (created_at, id); of equal rows either may come first.  To be stored, since numbers differ from run to run.

    Rows without a time come first, as in that order, and have numbers below -1.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "created_at", "id").sortWithinPartitions("created_at", "id")
    n = F.monotonically_increasing_id() - F.when(F.col("created_at").isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    return ordered.select(*keep, n.alias("n"))


def link_documents(docs: DataFrame, keys: DataFrame, shipments: DataFrame | None = None,
                   shipment_keys: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Shipment of every document as if they had arrived one by one in (created_at, document_id) order.

    A document joins the shipment its first matching key leads to (see `link_to_shipments`)
    and adds its keys to it; without a match it founds one.  Existing shipments never merge.
    Out: document_id, shipment_id, founder (the founding document or existing shipment).

    Computed for all documents at once: from a guess of every assignment follows what each
    key pointed to at each time, and from that a better guess.  The assignments of the
    earliest documents are right at once and stay right, so repeating until nothing changes
    gives exactly the one-by-one result; following founders to their own founder keeps the
    number of rounds small.  Work per round is joins and aggregates on keys; a key shared by
    most documents reduces to the few shipments that can own it.

    Rounds work on numbers: documents and shipments are numbered in their order, keys that link
    anything at all as they come.  Tables of a round replace those of the one before, so disk does
    not grow with the rounds; `scratch` holds what the result is read from, for a caller that deletes it.
    """
    kept = scratch or Scratch(docs.sparkSession)
    rows = docs.select("created_at", F.col("document_id").alias("id"), F.lit(False).alias("is_old"))
    old = None
    if shipments is not None and shipment_keys is not None:
        dated = shipments.select("shipment_id", "created_at")
        held = shipments.select("shipment_id", "created_at", F.col("reference_key").alias("key"), F.lit(0).alias("kind")).unionByName(
            shipment_keys.select("shipment_id", "key").join(dated, "shipment_id").withColumn("kind", F.lit(1)))
        old = kept.keep(held.join(keys.select("key").distinct(), "key", "left_semi"), "known-keys")
        rows = rows.unionByName(old.select("created_at", F.col("shipment_id").alias("id"), F.lit(True).alias("is_old")).distinct())
    numbered = kept.keep(_numbered(rows, "created_at", "id", "is_old"), "numbered")
    # d stands for the document, n for a row of it: they differ only where an id comes again
    own = Window.partitionBy("document_id")
    table = numbered.filter("not is_old").withColumnRenamed("id", "document_id").select(
        "document_id", F.min("n").over(own).alias("d"), F.min("n").over(Window.partitionBy("document_id", "created_at")).alias("n"))
    documents = kept.keep(table, "documents")
    keyed = documents.join(keys.select("document_id", "key", "rank"), "document_id").select(
        "d", "n", "key", "rank", (F.col("rank") == F.min("rank").over(own)).alias("is_first")).filter("key IS NOT NULL")
    keyed = kept.keep(keyed, "keyed-documents")
    holders = keyed.select("key", "n")
    if old is not None:
        # known shipments were there before all dated documents
        numbers = numbered.filter("is_old").select(F.col("id").alias("shipment_id"), "created_at", F.col("n").alias("fo"))
        same = [F.col("s.shipment_id") == F.col("m.shipment_id"), F.col("s.created_at").eqNullSafe(F.col("m.created_at"))]
        old = kept.keep(old.alias("s").join(numbers.alias("m"), same).select("key", "kind", F.lit(-1).cast("long").alias("t"), "fo"), "known-events")
        holders = holders.unionByName(old.select("key", F.col("t").alias("n")))
    # what only one document holds links nothing
    shared = kept.keep(holders.groupBy("key").agg(F.min("n").alias("low"), F.max("n").alias("high")).filter("low < high").select(
        "key", F.monotonically_increasing_id().alias("key_no")), "shared-keys")
    base = kept.keep(keyed.join(shared, "key").select("d", "n", F.col("key_no").alias("key"), "rank", "is_first"), "shared-rows")
    if old is not None:
        old = kept.keep(old.join(shared, "key").select(F.col("key_no").alias("key"), "kind", "t", "fo"), "old-events")
    kept.drop("known-keys", "known-events", "keyed-documents", "shared-keys")

    guess = None
    while True:
        # at first every document is its own founder
        placed = base.withColumn("fo", F.col("d")) if guess is None else base.join(guess, "d")
        holding = placed.groupBy("key", "fo").agg(F.min("n").alias("t")).select("key", F.lit(1).alias("kind"), "t", "fo")
        primary = placed.filter(F.col("is_first") & (F.col("fo") == F.col("d"))).select(
            "key", F.lit(0).alias("kind"), F.col("n").alias("t"), "fo")
        events = holding.unionByName(primary)
        if old is not None:
            events = events.unionByName(old)
        # a later holder matters only when its shipment is older than the first holder's
        events = kept.keep(events, "key-events")
        lead = kept.keep(events.groupBy("key", "kind").agg(F.min_by("fo", F.struct("t", "fo")).alias("lead_fo")), "key-leads")
        short = events.join(lead, ["key", "kind"]).filter(F.col("fo") <= F.col("lead_fo"))
        w = Window.partitionBy("key", "kind").orderBy("t", "fo").rowsBetween(Window.unboundedPreceding, -1)
        front = kept.keep(short.withColumn("before", F.min("fo").over(w)).filter(
            F.col("before").isNull() | (F.col("fo") < F.col("before"))).select("key", "kind", "t", "fo"), "key-fronts")
        kept.drop("key-events", "key-leads")
        hit = base.select("d", "n", "key", "rank").join(front, "key").filter(F.col("t") < F.col("n"))
        best = hit.groupBy("d").agg(F.min(F.struct("rank", "kind", "fo")).alias("b")).select("d", F.col("b.fo").alias("fo"))
        if guess is None:
            step = base.select("d").distinct().join(best, "d", "left").select("d", F.col("d").alias("was"), F.coalesce("fo", "d").alias("fo"))
        else:
            step = guess.select("d", F.col("fo").alias("was")).join(best, "d", "left").select("d", "was", F.coalesce("fo", "d").alias("fo"))
        step = kept.keep(step, "steps")
        # only a founder that has one itself leads further
        up = step.filter("fo <> d").select(F.col("d").alias("fo"), F.col("fo").alias("up"))
        new = kept.keep(step.join(up, "fo", "left").select("d", "was", F.coalesce("up", "fo").alias("fo")), "guess")
        kept.drop("key-fronts", "steps")
        guess = new.drop("was")
        if new.filter("fo <> was").isEmpty():
            break

    kept.drop("shared-rows", "old-events")
    names = documents.filter("n = d").select(F.col("d").alias("fo"), F.col("document_id").alias("founder"), F.lit(None).cast("string").alias("known")).distinct()
    if old is not None:
        names = names.unionByName(numbered.filter("is_old").select(F.col("n").alias("fo"), F.col("id").alias("founder"), F.col("id").alias("known")))
    else:
        kept.drop("numbered")
    linked = documents.select("document_id", "d").join(guess.filter("fo <> d").join(names, "fo").select("d", "founder", "known"), "d", "left")
    founder = F.coalesce("founder", F.col("document_id"))
    return linked.select("document_id", F.coalesce("known", F.concat(F.lit("shp_"), founder)).alias("shipment_id"), founder.alias("founder"))


def link_components(keys: DataFrame, max_key_frequency: int | None = None) -> DataFrame:
    """Connected components of documents that share any key: document_id, component.

    The component is its smallest document id.  Each round every key takes the smallest of its
    nodes, every node the smallest of its keys, and that node's own; then nodes become what they
    point to, and keys that tell no two nodes apart drop out.  What is left shrinks from round to
    round, so all rounds together cost little more than the first.  Edges are (node, key) rows; document
    pairs are never formed.  `max_key_frequency` drops over-common keys (off by default: exact).
    """
    # made once: edges, key sizes and labels all read it
    keys = stored(keys.select("document_id", "key").distinct(), "keys")
    edges = keys.filter("document_id IS NOT NULL AND key IS NOT NULL").select(F.col("document_id").alias("node"), "key")
    if max_key_frequency is not None:
        common = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_key_frequency)
        edges = edges.join(common, "key", "left_anti")
    steps: list[DataFrame] = []
    while True:
        # a key with one node connects nothing
        shared = stored(edges.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).filter("n > 1").drop("n"), "key-labels")
        if shared.isEmpty():
            break
        linked = stored(edges.join(shared, "key"), "linked")
        up = stored(linked.groupBy("node").agg(F.min("low").alias("up")), "node-labels")
        step = stored(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")), "steps")
        steps.append(step)
        edges = stored(linked.select("node", "key").join(step, "node").select(F.col("up").alias("node"), "key").distinct(), "edges")
    labels = keys.select("document_id").distinct()
    if not steps:
        return labels.withColumn("component", F.col("document_id"))
    # the later steps, of ever fewer nodes, are put into the earlier ones
    whole = steps.pop()
    while steps:
        later = whole.select(F.col("node").alias("up"), F.col("up").alias("top"))
        whole = stored(steps.pop().join(later, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "whole-steps")
    return labels.join(whole.withColumnRenamed("node", "document_id"), "document_id", "left").select(
        "document_id", F.coalesce("up", "document_id").alias("component"))


def shipment_keys_table(links: DataFrame, keys: DataFrame, docs: DataFrame) -> DataFrame:
    """Keys of each shipment in order of first appearance: shipment_id, key, first_seen, rank."""
    j = links.select("document_id", "shipment_id").join(keys, "document_id").join(
        docs.select("document_id", "created_at"), "document_id")
    return j.groupBy("shipment_id", "key").agg(
        F.min(F.struct("created_at", "document_id", "rank")).alias("f")
    ).select("shipment_id", "key", F.col("f.created_at").alias("first_seen"), F.col("f.rank").alias("rank"))


def shipment_rollup(links: DataFrame, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Per shipment: reference key, documents, distinct keys, documents per class as text.

    Member and key lists stay in their own tables (`links`, `shipment_keys_table`), so a
    shipment that holds most documents is still one small row.
    """
    members = links.select("document_id", "shipment_id").join(
        docs.select("document_id", F.coalesce("class_id", F.lit("unknown")).alias("class_id"), "created_at"), "document_id")
    per_class = members.groupBy("shipment_id", "class_id").agg(
        F.countDistinct("document_id").alias("n"), F.min(F.struct("created_at", "document_id")).alias("f"))
    rollup = per_class.groupBy("shipment_id").agg(
        F.sum("n").alias("document_count"), F.min("f").alias("f"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_id", "n"))),
                                 lambda s: F.concat(s["class_id"], F.lit("="), s["n"])), ",").alias("class_summary"))
    key_count = links.select("document_id", "shipment_id").join(keys, "document_id").groupBy("shipment_id").agg(
        F.countDistinct("key").alias("key_count"))
    primary = reference_key(keys, docs).withColumnRenamed("document_id", "first_document_id")
    return rollup.select("shipment_id", "document_count", "class_summary", F.col("f.created_at").alias("created_at"),
                         F.col("f.document_id").alias("first_document_id")).join(
        key_count, "shipment_id", "left").join(primary, "first_document_id", "left").select(
        "shipment_id", "reference_key", "document_count", F.coalesce("key_count", F.lit(0)).alias("key_count"),
        "class_summary", "first_document_id", "created_at")


def shipment_closure(links: DataFrame, docs: DataFrame) -> DataFrame:
    """A shipment is COMPLETE when all its documents are in a terminal state."""
    done = links.select("document_id", "shipment_id").join(docs.select("document_id", "status"), "document_id").groupBy(
        "shipment_id").agg(F.count(F.lit(1)).alias("document_count"),
                           F.count_if(F.col("status").isin(TERMINAL_STATES)).alias("terminal_count"))
    return done.withColumn("status", F.when(F.col("document_count") == F.col("terminal_count"), "COMPLETE").otherwise("OPEN"))


def shipment_documents(links: DataFrame, docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents of each shipment with class, status and number of fields."""
    counts = fields.groupBy("document_id").agg(F.count(F.lit(1)).alias("field_count"))
    return links.select("document_id", "shipment_id").join(
        docs.select("document_id", "class_id", "status", "created_at"), "document_id").join(
        counts, "document_id", "left").withColumn("field_count", F.coalesce("field_count", F.lit(0)))


def merge_keys(a: Column, b: Column) -> Column:
    """Ordered union of two key lists."""
    return F.array_distinct(F.concat(a, b))
