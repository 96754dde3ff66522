"""Problem 1: one label per item and attribute from annotators who disagree.

Latent ability and difficulty, learnt jointly by gradient expectation
maximisation: annotator j gives item i's right label with probability
``sigmoid(beta_i * (alpha_j + gamma_j * c_ij))`` where ``alpha_j`` is the
annotator's ability on the attribute, ``gamma_j`` how much the annotator's own
confidence tells (``c_ij``, standardised within the annotator, 0 where null)
and ``beta_i > 0`` the item's ease; a wrong label is any other one alike.

Annotators that copy each other would count several times, so the share of
equal errors is learnt for every pair, and a vote that repeats another's label
counts only as far as the pair is independent.

Votes are packed once, one row per item and attribute. Every pass maps over
the packed rows, finds the items' own posteriors and ease in numpy, and sends
back sums of the size of the annotator table; only these reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalore.plans.runtime import cut_lineage

ATTRIBUTES = ("kind", "palette", "setting")
#: Equal errors beyond this share of all joint errors count as dependence.
DEPENDENT = 0.25
#: Annotators that give the same label this often, on so many items, start as one.
IDENTICAL, LEAST_JOINT = 0.97, 20


def plain(column):
    """A spelling's plain form: lower case, words joined by one ``_``."""
    spaced = F.regexp_replace(F.trim(column), r"([\p{Ll}\d])(\p{Lu})", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(spaced), r"[\s_\-]+", "_"), r"^_+|_+$", "")


def votes(tags_items: DataFrame, item_data: DataFrame, tags: DataFrame, attributes=ATTRIBUTES) -> DataFrame:
    """(item_id, namespace, name, annotator, confidence): each distinct vote once.

    The attribute is the last ``:`` part of a tag's namespace. A null item_id is
    taken from item_data; votes without item, annotator, label or attribute are
    none. Repeated rows count once, with their mean confidence.
    """
    named = tags.select(
        F.col("id").alias("tag_id"),
        F.trim(F.lower(F.element_at(F.split("namespace", ":"), -1))).alias("namespace"),
        plain(F.col("name")).alias("name"),
    ).where(F.col("namespace").isin(*attributes) & (F.length("name") > 0))
    made = item_data.select(F.col("id").alias("item_data_id"), F.col("item_id").alias("made_for"), F.col("setter_id").alias("annotator"))
    rows = tags_items.select("item_data_id", "tag_id", "item_id", "confidence").join(named, "tag_id").join(made, "item_data_id")
    rows = rows.withColumn("item_id", F.coalesce("item_id", "made_for")).where("item_id is not null and annotator is not null")
    sure = F.when(F.isnan("confidence"), None).otherwise(F.col("confidence"))
    return rows.groupBy("item_id", "namespace", "name", "annotator").agg(F.avg(sure).alias("confidence"))


class _Parameters:
    """What one pass needs: names, abilities, dependence. All of the size of the annotator table."""

    def __init__(self, annotators, labels):
        self.annotators, self.labels = annotators, labels
        self.attributes = sorted(labels)
        n, a = len(annotators), len(self.attributes)
        self.alpha, self.gamma = np.full((a, n), 1.5), np.zeros((a, n))
        self.prior = [np.full(len(labels[x]), 1.0 / len(labels[x])) for x in self.attributes]
        self.copies: dict[tuple[int, int], float] = {}


class _Belief:
    """Posteriors of one batch, over the labels that an item's votes name and one class for all others.

    ``pair`` gives each vote's place among the distinct (item, label) pairs, which
    are sorted by item; labels nobody names share ``rest`` by their prior.
    """

    def __init__(self, item, what, prior):
        self.n, self.prior = int(item.max()) + 1, prior
        codes, self.pair = np.unique(item * len(prior) + what, return_inverse=True)
        self.item, self.label = codes // len(prior), codes % len(prior)
        self.first = np.searchsorted(self.item, np.arange(self.n))
        self.unnamed = np.maximum(1.0 - np.bincount(self.item, prior[self.label], self.n), 1e-12)

    def update(self, base, gain):
        """Posteriors from every item's weight of wrong votes and every pair's gain."""
        z = np.log(self.prior[self.label] + 1e-12) + base[self.item] + gain
        rest = np.log(self.unnamed) + base
        top = np.maximum(np.maximum.reduceat(z, self.first), rest)
        self.z, self.rest = np.exp(z - top[self.item]), np.exp(rest - top)
        whole = np.bincount(self.item, self.z, self.n) + self.rest
        self.z, self.rest = self.z / whole[self.item], self.rest / whole

    def best(self):
        """(label, posterior) of each item among the named ones; ties go to the first label."""
        order = np.lexsort((self.label, -self.z, self.item))
        at = order[np.searchsorted(self.item[order], np.arange(self.n))]
        return self.label[at], self.z[at]

    def totals(self):
        """Expected items of each label."""
        share = self.rest / self.unnamed
        k = len(self.prior)
        named = np.bincount(self.label, self.z - self.prior[self.label] * share[self.item], k)
        return np.maximum(named + self.prior * share.sum(), 0.0)


def _posteriors(x, item, who, what, sure, p, inner=8):
    """Belief, ease, and per vote: its posterior, right chance, weight."""
    k = len(p.prior[x])
    belief = _Belief(item, what, p.prior[x])
    n = belief.n
    strength = p.alpha[x][who] + p.gamma[x][who] * sure
    weight = np.ones(len(item))
    if p.copies:
        # a vote repeats those of abler annotators of the same item and label
        order = np.lexsort((-p.alpha[x][who], what, item))
        same = belief.pair[order]
        step = 1
        while True:
            hit = np.flatnonzero(same[step:] == same[:-step]) if step < len(same) else np.zeros(0, int)
            if not len(hit):
                break
            u, v = who[order[hit]], who[order[hit + step]]
            rho = np.fromiter((p.copies.get((min(s, t), max(s, t)), 0.0) for s, t in zip(u.tolist(), v.tolist())), float, len(hit))
            weight[order[hit + step]] *= 1.0 - rho
            step += 1
    b = np.zeros(n)
    for _ in range(inner):
        ease = np.exp(b)
        logit = ease[item] * strength
        s = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
        right, wrong = np.log(s + 1e-12), np.log(1.0 - s + 1e-12) - np.log(max(k - 1, 1))
        belief.update(np.bincount(item, weight * wrong, n), np.bincount(belief.pair, weight * (right - wrong), len(belief.item)))
        hit = belief.z[belief.pair]
        slope = np.bincount(item, weight * (hit - s) * logit, n) - b
        curve = np.bincount(item, weight * s * (1 - s) * logit * logit, n) + 1.0
        b = np.clip(b + 0.5 * slope / curve, -2, 2)
    return belief, np.exp(b), hit, s, weight


def _unpack(batch, p):
    """Per attribute: (rows, item, annotator, label, standardised confidence) as arrays."""
    namespaces = np.asarray(batch.column("namespace").to_pylist(), dtype=object)
    place = {a: i for i, a in enumerate(p.annotators)}
    for x, attribute in enumerate(p.attributes):
        rows = np.flatnonzero(namespaces == attribute)
        if not len(rows):
            continue
        lists = batch.column("votes").take(pa.array(rows))
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        known = {label: i for i, label in enumerate(p.labels[attribute])}
        item = np.repeat(np.arange(len(rows)), lengths)
        who = np.fromiter((place[v] for v in flat.field(0).to_pylist()), int, len(flat))
        what = np.fromiter((known[v] for v in flat.field(1).to_pylist()), int, len(flat))
        yield x, rows, item, who, what, np.asarray(flat.field(2).to_pylist(), dtype=float)


def _sums(p):
    def run(batches):
        n, parts = len(p.annotators), {}
        joint: dict[int, np.ndarray] = {}
        for batch in batches:
            for x, _, item, who, what, sure in _unpack(batch, p):
                belief, ease, hit, s, w = _posteriors(x, item, who, what, sure, p)
                e = ease[item]
                sums = np.stack([np.bincount(who, v, n) for v in (w * (hit - s) * e, w * s * (1 - s) * e * e, w * (hit - s) * e * sure, w * s * (1 - s) * (e * sure) ** 2, hit, np.ones(len(hit)))])
                old = parts.get(x)
                parts[x] = [sums, belief.totals()] if old is None else [old[0] + sums, old[1] + belief.totals()]
                order = np.argsort(item, kind="stable")
                step = 1
                while step < len(order):
                    at = np.flatnonzero(item[order[step:]] == item[order[:-step]])
                    if not len(at):
                        break
                    u, v = order[at], order[at + step]
                    equal = what[u] == what[v]
                    zu, zv = hit[u], hit[v]
                    miss = np.where(equal, 1 - zu, np.maximum(1 - zu - zv, 0))
                    code = np.minimum(who[u], who[v]) * n + np.maximum(who[u], who[v])
                    named, at = np.unique(code, return_inverse=True)
                    four = np.stack([np.bincount(at, v, len(named)) for v in (miss * equal, miss, equal, np.ones(len(at)))], 1)
                    for c, v in zip(named.tolist(), four):
                        if c // n != c % n:
                            joint[c] = joint.get(c, 0.0) + v
                    step += 1
        out = [(x, "who", i, -1, *sums[:, i].tolist()) for x, (sums, _) in parts.items() for i in range(n) if sums[5, i]]
        out += [(x, "label", i, -1, float(v), 0.0, 0.0, 0.0, 0.0, 0.0) for x, (_, prior) in parts.items() for i, v in enumerate(prior)]
        out += [(-1, "pair", c // n, c % n, *v.tolist(), 0.0, 0.0) for c, v in joint.items()]
        if out:
            names = ["x", "what", "i", "j", "a", "b", "c", "d", "e", "f"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _answers(p):
    def run(batches):
        for batch in batches:
            for x, rows, item, who, what, sure in _unpack(batch, p):
                belief, ease, *_ = _posteriors(x, item, who, what, sure, p)
                best, posterior = belief.best()
                n = len(rows)
                seen = np.bincount(belief.pair)
                count = np.bincount(belief.item, seen, n).astype(np.int64)
                same = np.bincount(belief.item, seen * (seen - 1), n) / np.maximum(count * (count - 1), 1)
                # agreement beyond what the attribute's label shares would give by chance
                by_chance = float((p.prior[x] ** 2).sum())
                kappa = np.where(count > 1, (same - by_chance) / max(1 - by_chance, 1e-12), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item_id").take(pa.array(rows)),
                        pa.array([p.attributes[x]] * n, pa.string()),
                        pa.array([p.labels[p.attributes[x]][i] for i in best], pa.string()),
                        pa.array(posterior),
                        pa.array(kappa, mask=count < 2),
                        pa.array(1.0 / ease),
                        pa.array(np.bincount(belief.item, minlength=n), pa.int64()),
                        pa.array(count, pa.int64()),
                    ],
                    ["item_id", "namespace", "name", "posterior", "agreement", "difficulty", "labels", "votes"],
                )

    return run


class Consensus:
    """Fits the model; ``labels()`` and ``annotators()`` give the results.

    An empty vote table gives empty results. One vote alone is its item's label
    with a null agreement. Ties of the posterior go to the label first in
    alphabetical order.
    """

    LABELS = "item_id long, namespace string, name string, posterior double, agreement double, difficulty double, labels long, votes long"

    def __init__(self, votes: DataFrame, passes: int = 12):
        self.spark = votes.sparkSession
        spread = votes.groupBy("annotator").agg(F.avg("confidence").alias("middle"), F.stddev("confidence").alias("spread"))
        scaled = votes.join(F.broadcast(spread), "annotator").withColumn(
            "sure", F.coalesce(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.try_divide(F.col("confidence") - F.col("middle"), F.col("spread")))), F.lit(0.0))
        )
        packed = scaled.groupBy("item_id", "namespace").agg(F.sort_array(F.collect_list(F.struct("annotator", "name", "sure"))).alias("votes"))
        self.packed = cut_lineage(packed)
        flat = self.packed.select("namespace", F.explode("votes").alias("v")).select("namespace", "v.annotator", "v.name")
        named = flat.select("namespace", "name", F.lit(None).cast("long").alias("annotator")).distinct()
        named = named.unionByName(flat.select(F.lit(None).cast("string").alias("namespace"), F.lit(None).cast("string").alias("name"), "annotator").distinct())
        names = named.collect()  # the labels and the annotators, both dimension tables
        labels: dict[str, list[str]] = {}
        for r in sorted((r["namespace"], r["name"]) for r in names if r["namespace"] is not None):
            labels.setdefault(r[0], []).append(r[1])
        self.p = _Parameters(sorted(r["annotator"] for r in names if r["annotator"] is not None), labels)
        self.quality = {}
        for at in range(passes if names else 0):
            self._pass(at)

    def _pass(self, at: int) -> None:
        """One round. The first only finds annotators that are as good as one, lest a crowd of copies pass for skill."""
        p = self.p
        sums = self.packed.mapInArrow(_sums(p), "x long, what string, i long, j long, a double, b double, c double, d double, e double, f double")
        total = sums.groupBy("x", "what", "i", "j").agg(*[F.sum(c).alias(c) for c in "abcdef"])
        chance = 1.0 / max(min((len(v) for v in p.prior), default=2) - 1, 1)
        # of all pairs of annotators only the dependent ones come here
        if at < 3:
            dependent = (F.col("d") >= LEAST_JOINT) & (F.col("c") >= IDENTICAL * F.col("d"))
        else:
            dependent = (F.col("a") + 10 * chance) / (F.col("b") + 10) - chance > DEPENDENT * (1 - chance)
        rows = total.where((F.col("what") != "pair") | dependent).collect()
        prior = [np.zeros_like(v) for v in p.prior]
        p.copies = {}
        alpha, gamma = p.alpha.copy(), p.gamma.copy()
        for r in rows:
            x, i = r["x"], r["i"]
            if r["what"] == "who":
                if at:
                    alpha[x, i] += float(np.clip((r["a"] - 0.05 * alpha[x, i]) / (r["b"] + 0.05), -1.5, 1.5))
                    gamma[x, i] += float(np.clip((r["c"] - 0.5 * gamma[x, i]) / (r["d"] + 0.5), -1, 1))
                self.quality[(x, i)] = (r["e"], r["f"])
            elif r["what"] == "label":
                prior[x][i] += r["a"]
            elif chance < 1 or at < 3:
                p.copies[(i, r["j"])] = 1.0 if at < 3 else ((r["a"] + 10 * chance) / (r["b"] + 10) - chance) / (1 - chance)
        p.prior = [(v + 1) / (v + 1).sum() for v in prior]
        p.alpha, p.gamma = np.clip(alpha, -4, 6), np.clip(gamma, -3, 3)

    def labels(self) -> DataFrame:
        """One row per item and attribute: label, posterior, agreement beyond chance, difficulty."""
        return self.packed.mapInArrow(_answers(self.p), self.LABELS)

    def annotators(self) -> DataFrame:
        """(annotator, namespace, votes, reliability, ability, copies_of): how far each can be trusted."""
        p, rows = self.p, []
        for (x, i), (right, n) in sorted(self.quality.items()):
            twin = max(((v, a if b == i else b) for (a, b), v in p.copies.items() if i in (a, b)), default=(0.0, None))
            rows.append((p.annotators[i], p.attributes[x], int(n), float(right / n), float(p.alpha[x, i]), p.annotators[twin[1]] if twin[1] is not None else None))
        return self.spark.createDataFrame(rows, "annotator long, namespace string, votes long, reliability double, ability double, errs_like long")


def p1_found(tags_items: DataFrame, item_data: DataFrame, tags: DataFrame) -> DataFrame:
    """Items and attributes with at least two different labels, and the consensus label."""
    return Consensus(votes(tags_items, item_data, tags)).labels().where("labels > 1").select("item_id", "namespace", "name")


def p1_labels(tags_items: DataFrame, item_data: DataFrame, tags: DataFrame) -> DataFrame:
    """Every item's label per attribute, with its posterior and agreement."""
    return Consensus(votes(tags_items, item_data, tags)).labels()


def p1_annotators(tags_items: DataFrame, item_data: DataFrame, tags: DataFrame) -> DataFrame:
    """Reliability of every annotator."""
    return Consensus(votes(tags_items, item_data, tags)).annotators()
