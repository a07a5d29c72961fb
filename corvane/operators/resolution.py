"""Entity resolution: candidates by name and by vector, and the decision ladder.

Candidates are joins by normalised name, and matrix products of blocks of vectors within comparable types. A node's
decision depends on those of earlier nodes that share a name with it or are its candidates; ``resolve`` takes them in
rounds, each of which decides every node whose outcome no open decision can change. Its state is a narrow
table of nodes and the canonical nodes that they stand for; no group of nodes is ever held in one task. Nodes that repeat
the names and type of an earlier one are set aside, and join at the end by what the others made of those names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scoring import unit
from corvane.functions.text import entity_key
from corvane.sources.shared import Scratch

TOP, SIMILARITY, CONFIDENCE = 10, 0.80, 0.80
UNCLASSIFIED = "unclassified"

#: Rows of a block of vectors on average, and rows of it that are multiplied at a time.
BLOCK, STRIP = 4096, 512
#: Open nodes, at most, that end the rounds: they are folded in one task, some tens of MB of names and candidates.
LAST = 1 << 15

#: From a node (id, label, type) and its options (id, label, type, similarity) to the chosen option's id, or none, a
#: confidence, and maybe a list of aliases that the chosen one gets.
Judge = Callable[[dict, list[dict]], tuple]


def names(nodes: DataFrame) -> DataFrame:
    """(id, rank, type, name): every node's normalised label and aliases."""
    rows = nodes.select("id", "rank", "type", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return rows.withColumn("name", entity_key(F.col("name"))).filter("name <> ''").distinct()


def name_matches(incoming: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, match): for incoming nodes (id, rank, label, type, aliases), the canonical one of lowest rank that shares a
    normalised name and has a comparable type."""
    own = names(incoming).select("id", "type", "name")
    # one row for each name and type, and one for the name in any type, however many nodes share it
    best = names(canonical).groupBy("name", "type").agg(F.min(F.struct("rank", "id")).alias("best"))
    typed = own.filter(F.col("type") != UNCLASSIFIED).withColumn("meets", F.explode(F.array("type", F.lit(UNCLASSIFIED))))
    found = typed.join(best.withColumnRenamed("type", "meets"), ["name", "meets"]).select("id", "best")
    every = best.groupBy("name").agg(F.min("best").alias("best"))
    found = found.unionByName(own.filter(F.col("type") == UNCLASSIFIED).join(every, "name").select("id", "best"))
    return found.groupBy("id").agg(F.min("best").alias("best")).select("id", F.col("best.id").alias("match"))


def same_contribution(nodes: DataFrame, provenance: DataFrame) -> DataFrame:
    """(id, match): nodes (id, source, content_hash) that a canonical node's provenance names already, with the same source and
    content: they are that node, whatever their names."""
    known = provenance.groupBy("source", "content_hash", F.col("node_id").alias("id")).agg(F.min("canonical_node_id").alias("match"))
    return nodes.select("id", "source", "content_hash").join(known, ["source", "content_hash", "id"]).select("id", "match")


def unsettled(nodes: DataFrame) -> DataFrame:
    """The nodes (id, rank, type, label, aliases) that may be canonical or come to the judge.

    All others join by name whatever is decided elsewhere: an earlier node has one of their names and their own type (any
    type, for an unclassified node), and so has then the canonical node that it stands for.
    """
    own = names(nodes)
    typed = own.groupBy("name", "type").agg(F.min(F.struct("rank", "id")).alias("first"))
    every = typed.groupBy("name").agg(F.min("first").alias("first"))
    met = own.filter(F.col("type") != UNCLASSIFIED).join(typed, ["name", "type"]).select("id", "rank", "first")
    met = met.unionByName(own.filter(F.col("type") == UNCLASSIFIED).join(every, "name").select("id", "rank", "first"))
    return nodes.join(met.filter(F.struct("rank", "id") > F.col("first")).select("id"), "id", "left_anti")


def _best_in_block(top: int, least: float, earlier: bool):
    """Of each asking row the ``top`` most similar rows of a block, at least ``least``: one matrix product for a strip of rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.string()), "candidate": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.sort_by("id")  # ties go to the smaller id
        mine, other = (np.array(t.column("id").to_pylist(), object) for t in (left, right))
        matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        x, y = matrix(left), matrix(right)
        if earlier:
            both = pa.concat_tables([left.select(["rank", "id"]), right.select(["rank", "id"])])
            place = np.empty(both.num_rows, np.int64)
            place[pa.compute.sort_indices(both, [("rank", "ascending"), ("id", "ascending")]).to_numpy()] = np.arange(both.num_rows)
        ids, found, scores = [], [], []
        for at in range(0, len(x), STRIP):
            s = np.round(x[at : at + STRIP] @ y.T, 9)
            s[mine[at : at + STRIP, None] == other[None, :]] = -np.inf
            if earlier:
                s[place[at : at + len(s), None] <= place[None, len(x) :]] = -np.inf
            s[np.isnan(s)] = -np.inf
            # the top and all that tie with its last, then in order: a whole sort of each row is most of the work
            last = np.partition(s, -top, axis=1)[:, -top] if s.shape[1] > top else np.full(len(s), -np.inf)
            row, column = np.nonzero((s >= np.maximum(last, least)[:, None]) & (s > -np.inf))
            order = np.lexsort((column, -s[row, column], row))
            row, column = row[order], column[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < top
            row, column = row[kept], column[kept]
            ids.extend(mine[at + row])
            found.extend(other[column])
            scores.append(s[row, column])
        return pa.table({"id": pa.array(ids, pa.string()), "candidate": pa.array(found, pa.string()), "similarity": pa.array(np.concatenate(scores), pa.float64())})

    return run


def vector_candidates(incoming: DataFrame, canonical: DataFrame, top: int = TOP, least: float = SIMILARITY, earlier: bool = False) -> DataFrame:
    """(id, candidate, similarity, rank): up to ``top`` canonical nodes of a comparable type with a cosine of at least
    ``least``; ties by id. Both sides have (id, type, vector), and a rank if only ``earlier`` nodes are asked for.

    An unclassified incoming node asks all canonical ones, others their own type and the unclassified. Both sides of each of
    these are cut into blocks of about ``BLOCK`` rows by a hash of the id; each pair of blocks is one product, of
    which only the best of each row leave. Null vectors take no part.
    """
    names_ = ["id", *(["rank"] if earlier else []), "vector", "any", "kind", "width"]
    block = lambda any_type, kind: F.struct(any_type.alias("any"), kind.alias("kind"))
    whole, typed = block(F.lit(True), F.lit("")), block(F.lit(False), F.col("type"))
    meets = F.when(F.col("type") == UNCLASSIFIED, F.array(whole)).otherwise(F.array(typed, block(F.lit(False), F.lit(UNCLASSIFIED))))

    def placed(rows: DataFrame, blocks: Column) -> DataFrame:
        rows = rows.filter("vector is not null").withColumns({"vector": unit(F.col("vector")), "width": F.size("vector"), "b": F.explode(blocks)})
        rows = rows.withColumns({"any": F.col("b.any"), "kind": F.coalesce("b.kind", F.lit(""))})
        return rows.select(*[F.col(n).alias(n) for n in names_])  # names of its own, should both sides be one table

    left, right = placed(incoming, meets), placed(canonical, F.array(whole, typed))
    keys = ["any", "kind", "width"]
    count = lambda rows, name: rows.groupBy(keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    parts = count(left, "left_parts").join(count(right, "right_parts"), keys)
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cut = lambda rows, one, two: rows.join(parts, keys).withColumn("one", one).withColumn("two", two).drop("left_parts", "right_parts").groupBy(*keys, "one", "two")
    left = cut(left, own(F.col("left_parts")), every(F.col("right_parts")))
    right = cut(right, every(F.col("left_parts")), own(F.col("right_parts")))
    scored = left.cogroup(right).applyInArrow(_best_in_block(top, least, earlier), "id string, candidate string, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "candidate"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def _comparable(left: str, right: str) -> Column:
    return (F.col(left) == F.col(right)) | (F.col(left) == UNCLASSIFIED) | (F.col(right) == UNCLASSIFIED)


def _asked(judge: Judge, confidence: float):
    """Choices of rows (id, label, type, options, open): one call of the judge for each that has options and is not open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                if r.open or r.options is None:
                    out.append((r.id, not r.open, None, []))
                    continue
                options = [{k: o[k] for k in ("id", "label", "type", "similarity")} for o in r.options]
                choice, sure, *aliases = judge({"id": r.id, "label": r.label, "type": r.type}, options)
                accepted = choice is not None and sure >= confidence and choice in {o["id"] for o in options}
                out.append((r.id, True, choice if accepted else None, list(aliases[0]) if accepted and aliases else []))
            yield pd.DataFrame(out, columns=["id", "ready", "choice", "aliases"])

    return run


def _earlier_document() -> Column:
    return F.col("its_document").isNull() | F.col("document").isNull() | (F.col("its_document") < F.col("document"))


def _holders(done: DataFrame, base: DataFrame, named: DataFrame) -> DataFrame:
    """(name, target, since, kind, its_place, its_document): the names that decided nodes gave to canonical ones, from which
    place on, with the type that the canonical node has by now, its own or its first typed member's."""
    typed = F.col("type") != UNCLASSIFIED
    kinds = done.groupBy("target").agg(F.coalesce(F.min_by(F.when(typed, F.col("type")), F.when(typed, F.col("place"))), F.lit(UNCLASSIFIED)).alias("kind"))
    kinds = kinds.join(base.select(F.col("id").alias("target"), F.col("place").alias("its_place"), F.col("document").alias("its_document")), "target")
    held = done.join(named, "id", "left").groupBy("name", "target").agg(F.min("place").alias("since"))
    return held.join(kinds, "target")


def _offers(held: DataFrame) -> DataFrame:
    """Of the holders of a name, those that a node may choose: of many that have it from the start, the first of a kind."""
    late = F.when(F.col("since") != F.col("its_place"), F.col("since"))
    offers = held.filter("name is not null").groupBy("name", "kind", late.alias("late")).agg(F.min(F.struct("its_place", "since", "its_document", "target")).alias("o"))
    return offers.select("name", "kind", "o.*")


def _folded(judge: Judge | None, confidence: float):
    """The ladder over the last open nodes, in order, in one task."""
    ask = _asked(judge, confidence) if judge is not None else None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind, place, home, by_name, labels, out = {}, {}, {}, {}, {}, []
        key = lambda p: (p["rank"], p["id"])
        for r in rows.itertuples():
            for h in (*r.offers, *r.near):
                if h["target"] is not None:
                    kind[h["target"]], place[h["target"]], home[h["target"]] = h["kind"], key(h["its_place"]), h["its_document"]
            for h in r.offers:
                known = by_name.setdefault(h["name"], {})
                known[h["target"]] = min(known.get(h["target"], key(h["since"])), key(h["since"]))
            labels.update({h["candidate"]: h["label"] for h in r.near})
        for r in sorted(rows.itertuples(), key=lambda r: key(r.place)):
            mine = key(r.place)
            free = lambda c: home[c] is None or r.document is None or home[c] < r.document  # noqa: B023, E731
            fits = lambda c: c in kind and free(c) and UNCLASSIFIED in (kind[c], r.type) or kind.get(c) == r.type and free(c)  # noqa: B023, E731
            found = {c for n in r.names for c, since in by_name.get(n, {}).items() if since < mine and fits(c)}
            target, aliases = min(found, key=place.get, default=None), []
            if target is None and ask is not None:
                near = sorted((-h["similarity"], h["candidate"]) for h in r.near if fits(h["candidate"]))
                options = [{"id": c, "label": labels[c], "type": kind[c], "similarity": -d} for d, c in near]
                if options:
                    [answer] = ask(iter([pd.DataFrame([(r.id, r.label, r.type, options, False)], columns=["id", "label", "type", "options", "open"])]))
                    target, aliases = answer["choice"][0], answer["aliases"][0]
            if target is None:
                target = r.id
                kind[target], place[target], home[target] = r.type, mine, r.document
            elif kind[target] == UNCLASSIFIED:
                kind[target] = r.type
            for n in r.names:
                by_name.setdefault(n, {}).setdefault(target, mine)
            out.append((r.id, target, aliases))
        return pd.DataFrame(out, columns=["id", "choice", "aliases"])

    return run


def _last(still: DataFrame, held: DataFrame, named: DataFrame, pairs: DataFrame | None, base: DataFrame, judge: Judge | None, confidence: float) -> DataFrame:
    """(id, choice, aliases) of at most ``LAST`` open nodes."""
    offers = still.select("id").join(named, "id").join(_offers(held), "name").groupBy("id").agg(F.collect_list(F.struct("name", "target", "since", "kind", "its_place", "its_document")).alias("offers"))
    rows = still.join(base.select("id", "label"), "id").join(offers, "id", "left").join(named.groupBy("id").agg(F.collect_list("name").alias("names")), "id", "left")
    if pairs is not None:
        canonical = held.select("target", "kind", "its_place", "its_document").distinct()
        near = pairs.join(still.select("id"), "id", "left_semi").join(base.select(F.col("id").alias("candidate"), "label"), "candidate").join(canonical, F.col("candidate") == F.col("target"), "left")
        rows = rows.join(near.groupBy("id").agg(F.collect_list(F.struct("candidate", "label", "similarity", "target", "kind", "its_place", "its_document")).alias("near")), "id", "left")
    else:
        rows = rows.withColumn("near", F.array(F.struct(F.lit("").alias("candidate"), F.lit("").alias("label"))).cast("array<struct<candidate:string,label:string>>")).withColumn("near", F.slice("near", 1, 0))
    rows = rows.select("id", "place", "type", "label", "document", *[F.coalesce(c, F.array()).alias(c) for c in ("names", "offers", "near")], F.lit(True).alias("all"))
    return rows.groupBy("all").applyInPandas(_folded(judge if pairs is not None else None, confidence), "id string, choice string, aliases array<string>")


def _matches(still: DataFrame, held: DataFrame, named: DataFrame) -> DataFrame:
    """(id, best, best_kind): of each open node the canonical one of the lowest place that has one of its names by its turn."""
    met = still.join(named, "id").join(_offers(held), "name").filter((F.col("since") < F.col("place")) & _comparable("kind", "type") & _earlier_document())
    return met.groupBy("id").agg(F.min(F.struct("its_place", "kind")).alias("m")).select("id", F.col("m.its_place").alias("best"), F.col("m.kind").alias("best_kind"))


def _links(typed: DataFrame) -> DataFrame:
    """(id, key): nodes of comparable types that share a name share a key. Typed nodes are linked under a name by their type
    and to its unclassified ones, which are linked with every type that the name has."""
    loose = typed.filter(F.col("type") == UNCLASSIFIED).select("id", "name").join(typed.select("name", "type").distinct(), "name")
    return typed.select("id", "name", "type").unionByName(loose.select("id", "name", "type")).select("id", F.xxhash64("name", "type").alias("key")).distinct()


def _comers(still: DataFrame, held: DataFrame, named: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(target, comer): of unclassified canonical nodes the first open node that could join them."""
    untyped = held.filter(F.col("kind") == UNCLASSIFIED)
    first = still.join(named, "id").groupBy("name").agg(F.min("place").alias("place"))
    rows = untyped.join(first, "name").select("target", "place")
    if pairs is not None:
        rows = rows.unionByName(pairs.join(still.select("id", "place"), "id").select(F.col("candidate").alias("target"), "place").join(untyped, "target", "left_semi"))
    return rows.groupBy("target").agg(F.min("place").alias("comer"))


def _lowest(scratch: Scratch, low: DataFrame, links: DataFrame) -> DataFrame:
    """(id, low): the least ``low`` among the nodes that links (id, key) connect with each, spread until nothing changes."""
    low = scratch.write(low, "low")
    own = scratch.write(links.join(low.select("id"), "id", "left_semi"), "own-links")
    while True:
        by_key = own.join(low, "id").groupBy("key").agg(F.min("low").alias("l"))
        spread = own.join(by_key, "key").groupBy("id").agg(F.min("l").alias("l"))
        after = scratch.write(low.join(spread, "id", "left").select("id", F.least("low", "l").alias("low"), (F.col("l") < F.col("low")).alias("fell")), "low")
        low = after.select("id", "low")
        if after.filter("fell").isEmpty():
            return low


def _judged(turn: DataFrame, pairs: DataFrame, held: DataFrame, comers: DataFrame, base: DataFrame, judge: Judge, confidence: float) -> DataFrame:
    """(id, ready, choice, aliases) of nodes whose turn it is: not ready are those with an unclassified candidate whose type is open."""
    canonical = held.select(F.col("target").alias("candidate"), "kind", "its_document").distinct()
    met = turn.join(pairs, "id").join(canonical, "candidate").filter(_comparable("kind", "type") & _earlier_document())
    met = met.join(comers.withColumnRenamed("target", "candidate"), "candidate", "left").join(base.select(F.col("id").alias("candidate"), F.col("label").alias("its_label")), "candidate")
    open_type = (F.col("type") != UNCLASSIFIED) & (F.col("kind") == UNCLASSIFIED) & F.coalesce(F.col("comer") < F.col("place"), F.lit(False))
    option = F.struct(F.negative("similarity").alias("order"), F.col("candidate").alias("id"), F.col("its_label").alias("label"), F.col("kind").alias("type"), "similarity")
    listed = met.groupBy("id").agg(F.array_sort(F.collect_list(option)).alias("options"), F.bool_or(open_type).alias("open"))
    rows = turn.join(base.select("id", "label"), "id").join(listed, "id", "left")
    return rows.select("id", "label", "type", "options", F.coalesce("open", F.lit(False)).alias("open")).mapInPandas(_asked(judge, confidence), "id string, ready boolean, choice string, aliases array<string>")


def _told(nodes: DataFrame) -> DataFrame:
    """(id, place, type, names, told): false for nodes with the names and type of an earlier one. Told are all without a name or
    a type, all fixed ones, and all of documents, within which nodes stay apart."""
    every = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    own = F.array_sort(F.array_distinct(F.filter(F.transform(every, entity_key), lambda n: n != "")))
    apart = (F.size(own) == 0) | F.col("type").isNull()
    apart = apart | F.coalesce(F.col("fixed"), F.lit(False)) if "fixed" in nodes.columns else apart
    apart = apart | F.col("document").isNotNull() if "document" in nodes.columns else apart
    rows = nodes.select("id", F.struct("rank", "id").alias("place"), "type", own.alias("names"), apart.alias("apart"))
    first = rows.groupBy("names", "type").agg(F.min("place").alias("first"))
    rows = rows.join(first, ["names", "type"], "left")
    return rows.select("id", "place", "type", "names", (F.col("apart") | F.coalesce(F.col("place") == F.col("first"), F.lit(True))).alias("told"))


def _repeats(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, place, type, names, canonical, tells) of the rows that are not told, from what the told came to (id, canonical): the
    canonical node that each joins by name, and whether it tells that one a name or its type, or joins none."""
    done = rows.filter("told").join(found.select("id", "canonical"), "id")
    # what a canonical node is and has from which place on, one row for each set of names and type
    typed = done.filter(F.col("type") != UNCLASSIFIED).groupBy("canonical").agg(F.min(F.struct("place", "type")).alias("kind"))
    its = done.filter("id = canonical").select("canonical", F.col("place").alias("its_place")).join(typed, "canonical", "left")
    held = done.select("canonical", "place", F.explode("names").alias("name")).groupBy("name", "canonical").agg(F.min("place").alias("since"))
    asked = rows.filter("not told").select("names", "type").distinct().select("names", "type", F.explode("names").alias("name"))
    some = asked.join(held, "name").groupBy("names", "type", "canonical").agg(F.min("since").alias("one"), F.max("since").alias("last"), F.count("*").alias("n"))
    some = some.join(its, "canonical").withColumn("all", F.when(F.col("n") == F.size("names"), F.col("last")))
    offers = some.groupBy("names", "type").agg(F.array_sort(F.collect_list(F.struct("its_place", "canonical", "one", "all", "kind"))).alias("offers"))
    kind = lambda o: F.when(o["kind"]["place"] < F.col("place"), o["kind"]["type"]).otherwise(UNCLASSIFIED)
    fits = lambda o: (o["one"] < F.col("place")) & ((F.col("type") == UNCLASSIFIED) | kind(o).isin(UNCLASSIFIED) | (kind(o) == F.col("type")))
    met = rows.filter("not told").drop("told").join(offers, ["names", "type"], "left").withColumn("o", F.get(F.filter("offers", fits), F.lit(0)))
    whole = F.coalesce(F.col("o.all") < F.col("place"), F.lit(False))
    retyped = (kind(F.col("o")) == UNCLASSIFIED) & (F.col("type") != UNCLASSIFIED)
    return met.select("id", "place", "type", "names", F.col("o.canonical").alias("canonical"), (~whole | retyped).alias("tells"))


def resolve(nodes: DataFrame, pairs: DataFrame | None = None, judge: Judge | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, canonical, aliases) of nodes (id, rank, label, type, aliases): who each stands for, as if taken in order of rank.

    A node joins the earlier canonical node of lowest rank that has one of its normalised names, names learnt from merges
    included, and a comparable type; else ``judge`` may choose one of its earlier vector candidates (pairs: id, candidate,
    similarity) with enough confidence; else it is canonical itself. Candidates are asked for that are canonical and of a
    comparable type when the node's turn comes; an unclassified canonical node takes the type of its first typed member.
    ``aliases`` are names that the judge gave with its choice: the caller's to store, they match nothing in this call.

    Optional columns: nodes with a true ``fixed`` are canonical whatever they share; with a ``document`` (ordered as the ranks
    are) only canonical nodes of earlier documents are candidates, so that a document's nodes stay apart.

    Each round decides (a) nodes that no open earlier node of a comparable type shares a name with, whose candidates are
    decided, and (b) nodes that match the canonical node of the lowest place that anything open linked with them could
    still bring: of a name that a third of all nodes share, all join at once when its first one is decided. Both wait where an
    open earlier node could give an unclassified target its type. The first open node is always decided. The last ``LAST`` open
    nodes, of whatever number, are taken in order in one task.

    Before all that, nodes that have the names and type of an earlier one are set aside, and the rounds run over the others. Under
    what these come to, each repeat joins by name; if its target had its names and a type before, its turn changed nothing.
    Repeats that would have told their target something are taken into the rounds, which begin anew, until none is left: a judge
    may then be asked the same again.
    """
    scratch = Scratch(nodes.sparkSession)
    rows = scratch.write(_told(nodes), "told")
    while not rows.filter("not told").isEmpty():
        found = _in_rounds(nodes.join(rows.filter("told").select("id"), "id", "left_semi"), pairs, judge, confidence)
        repeats = scratch.write(_repeats(rows, found), "repeats")
        tells = repeats.filter("tells")
        if tells.isEmpty():
            scratch.keep_only(repeats)
            return found.unionByName(repeats.select("id", "canonical", F.array().cast("array<string>").alias("aliases")))
        first = F.row_number().over(Window.partitionBy("names", "type", "canonical").orderBy("place"))
        more = tells.withColumn("n", first).filter("n = 1 or canonical is null").select("id", F.lit(True).alias("more"))
        rows = scratch.write(rows.join(more, "id", "left").withColumn("told", F.col("told") | F.coalesce("more", F.lit(False))).drop("more"), "told")
        scratch.keep_only(rows)
    scratch.keep_only(rows)
    scratch.remove(rows)
    return _in_rounds(nodes, pairs, judge, confidence)


def _in_rounds(nodes: DataFrame, pairs: DataFrame | None, judge: Judge | None, confidence: float) -> DataFrame:
    """``resolve`` in rounds over all nodes."""
    pairs = pairs if judge is not None else None
    scratch = Scratch(nodes.sparkSession)
    fixed = F.coalesce(F.col("fixed"), F.lit(False)) if "fixed" in nodes.columns else F.lit(False)
    document = F.col("document") if "document" in nodes.columns else F.lit(None).cast("string")
    base = scratch.write(nodes.select("id", F.struct("rank", "id").alias("place"), "type", "label", fixed.alias("fixed"), document.alias("document")), "nodes")
    typed = scratch.write(names(nodes).select("id", "name", "type"), "names")
    named = typed.select("id", "name")
    pairs = scratch.write(pairs.select("id", "candidate", "similarity"), "pairs") if pairs is not None else None
    lasting, answers, links = [t for t in (base, typed, pairs) if t is not None], [], None
    state = scratch.write(base.select("id", "place", "type", "document", F.when(F.col("fixed"), F.col("place")).alias("target")), "state")
    while (left := state.filter("target is null").count()) > 0:
        still = state.filter("target is null").drop("target")
        held = scratch.write(_holders(state.filter("target is not null").select("id", "place", "type", F.col("target.id").alias("target")), base, named), "held")
        if left <= LAST:
            answers.append(scratch.write(_last(still, held, named, pairs, base, judge, confidence), "answers"))
            places = base.select(F.col("id").alias("choice"), F.col("place").alias("now"))
            state = state.join(answers[-1].join(places, "choice").select("id", "now"), "id", "left").select("id", "place", "type", "document", F.coalesce("target", "now").alias("target"))
            break
        if links is None:
            links = scratch.write(_links(typed), "links")
            lasting.append(links)
        comers = _comers(still, held, named, pairs)
        first = links.join(still, "id").groupBy("key").agg(F.min("place").alias("first"))
        first = links.join(still.select("id"), "id", "left_semi").join(first, "key").groupBy("id").agg(F.min("first").alias("first"))
        rows = still.join(_matches(still, held, named), "id", "left").join(first, "id", "left")
        rows = rows.join(comers.withColumnRenamed("target", "best_id"), F.col("best.id") == F.col("best_id"), "left").drop("best_id")
        if pairs is not None:
            seen = pairs.join(still.select("id"), "id", "left_semi").join(base.select(F.col("id").alias("candidate"), F.col("place").alias("near")), "candidate")
            seen = seen.join(still.select(F.col("id").alias("candidate"), F.lit(True).alias("open")), "candidate", "left")
            rows = rows.join(seen.groupBy("id").agg(F.min("near").alias("near"), F.bool_or("open").alias("open")), "id", "left")
        else:
            rows = rows.withColumns({"near": F.col("place"), "open": F.lit(False)})
        settled = (F.col("type") == UNCLASSIFIED) | (F.coalesce("best_kind", F.lit("")) != UNCLASSIFIED) | F.coalesce(F.col("comer") >= F.col("place"), F.lit(True))
        alone = F.coalesce(F.col("first") >= F.col("place"), F.lit(True))
        matched = F.col("best").isNotNull()
        rows = rows.withColumns({"joins": matched & settled & alone, "waiting": matched & settled & ~alone, "turn": ~matched & alone & ~F.coalesce("open", F.lit(False))})
        rows = scratch.write(rows, "round")
        counts = rows.agg(F.count_if("joins").alias("joins"), F.count_if("turn").alias("turn"), F.count_if("waiting").alias("waiting")).first()
        target = F.when(F.col("joins"), F.col("best"))
        if counts["waiting"] > counts["joins"] + counts["turn"]:
            low = _lowest(scratch, rows.select("id", F.least("place", "best", F.when(F.col("best").isNull(), F.col("near"))).alias("low")), links)
            rows = rows.join(low, "id")
            target = F.when(F.col("joins") | (F.col("waiting") & (F.col("low") == F.col("best"))), F.col("best"))
        now = rows.select("id", F.coalesce(target, F.when(F.col("turn"), F.col("place")) if pairs is None else target).alias("now"))
        if pairs is not None and counts["turn"]:
            turn = rows.filter("turn").select("id", "place", "type", "document")
            answer = scratch.write(_judged(turn, pairs, held, comers, base, judge, confidence), "answers")
            answers.append(answer)
            chosen = answer.filter("ready").join(base.select(F.col("id").alias("choice"), F.col("place").alias("accepted")), "choice", "left").join(base.select("id", F.col("place").alias("own")), "id")
            now = now.join(chosen.select("id", F.coalesce("accepted", "own").alias("asked")), "id", "left").select("id", F.coalesce("now", "asked").alias("now"))
        state = scratch.write(state.join(now, "id", "left").select("id", "place", "type", "document", F.coalesce("target", "now").alias("target")), "state")
        scratch.keep_only(state, *lasting, *answers)
    found, none = state.select("id", F.col("target.id").alias("canonical")), F.array().cast("array<string>")
    if answers:
        given = answers[0].select("id", "aliases")
        for answer in answers[1:]:
            given = given.unionByName(answer.select("id", "aliases"))
        given = given.filter(F.size("aliases") > 0)
        found = found.join(given, "id", "left")
    else:
        found = found.withColumn("aliases", none)
    return scratch.keep_only(scratch.write(found.select("id", "canonical", F.coalesce("aliases", none).alias("aliases")), "resolved"))
