"""Exact Jaccard join of word-shingle sets by PartEnum signatures (operator 9).

Sets fall into bands of similar size. Within a band, similar sets differ in at most k shingles, so of more than
k / 2 groups of the shingle domain one holds at most one difference, and of that group's parts all but one
agree: a set's signatures are all choices of all parts but one of a group. Whatever shares a signature is a
candidate, and candidates are verified on whole sets (``setjoin``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatframe.llm.setjoin import BROADCAST_ROWS, SetJoin, Sets, shortened, sums
from heatframe.llm.words import BASE, mix

SEEDS = 4
BAND_RATIO = 1.6
MOST_EXTRA = 40


class Bands:
    """Bands of set sizes and the differences that each must bear, for links at ``num / den``; groups have ``parts``."""

    def __init__(self, num: int, den: int, parts: int = 3):
        self.num, self.den, self.parts = num, den, parts
        self.lows = [1]
        self.known: dict[int, int] = {}

    def of(self, sizes: np.ndarray) -> np.ndarray:
        top = int(sizes.max(initial=1))
        while self.lows[-1] <= top:
            low = self.lows[-1]
            self.lows.append(max(low, int(low * BAND_RATIO)) + 1)
        return np.searchsorted(np.array(self.lows), sizes, "right") - 1

    def high(self, band: np.ndarray) -> np.ndarray:
        self.of(np.array([self.lows[int(band.max(initial=0))] * 4]))
        return np.array(self.lows)[band + 1] - 1

    def differences(self, band: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of two linked sets of which the larger is in the band."""
        return 2 * self.high(band) * (self.den - self.num) // (self.den + self.num)

    def groups(self, band: np.ndarray) -> np.ndarray:
        """Groups of the domain: over half the differences, and more where choices are empty by chance."""
        for j in np.unique(band).tolist():
            if j not in self.known:
                one = np.array([j])
                k, least = int(self.differences(one)[0]), self.num * int(self.high(one)[0]) / self.den
                for extra in range(MOST_EXTRA):
                    n = k // 2 + 1 + extra
                    empty = self.parts * n * np.exp(-least * (self.parts - 1) / (self.parts * n))
                    if 2 * n - k > empty + 3 * empty**0.5:
                        break
                self.known[j] = n
        return np.array([self.known[j] for j in band.tolist()], "i8")


def signatures(sets: Sets, chosen: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the text of each, for the chosen texts.

    A set is signed for its own band and every one above in which a larger partner can lie. A choice of parts
    that is empty says nothing; where so many are empty that a link may rest on them alone, which then holds for
    both sides, the set is signed again by another partition, and after the last one by its band.
    """
    out_sig, out_text = [], []
    own = bands.of(np.maximum(sets.sizes, 1))
    band, todo = own, chosen & (sets.sizes > 0)
    while todo.any():
        reached, k = todo, bands.differences(band)
        todo = todo & (k > 0)
        groups, parts = bands.groups(band), bands.parts
        # signatures that two linked sets share at least: the first difference of a group leaves one, the second none
        sure = 2 * groups - k
        for seed in range(SEEDS):
            if not todo.any():
                break
            first = np.concatenate([[0], np.cumsum(np.where(todo, groups, 0))])
            own_value = todo[sets.text]
            values, text = sets.values[own_value], sets.text[own_value]
            spread = mix(values + np.uint64((seed + 1) * 0x9E3779B9))
            part = ((spread >> np.uint64(20)) % (parts * groups[text]).astype("u8")).astype("i8") + parts * first[text]
            total = sums(spread, part, parts * first[-1]).reshape(-1, parts)
            filled = np.bincount(part, minlength=parts * first[-1]).reshape(-1, parts) > 0
            group_text = np.repeat(np.arange(sets.n), np.where(todo, groups, 0))
            number = (np.arange(first[-1]) - first[group_text]).astype("u8")
            tag = mix(number * BASE + (band[group_text] * SEEDS + seed).astype("u8"))
            empty = np.zeros(sets.n, "i8")
            for left in range(parts):
                says, sig = np.zeros(len(tag), bool), tag
                for p in range(parts):
                    if p != left:
                        says = says | filled[:, p]
                        sig = mix(sig * BASE + total[:, p])
                sig = mix(sig + np.uint64(left))
                out_sig.append(sig[says])
                out_text.append(group_text[says])
                empty += np.bincount(group_text[~says], minlength=sets.n)
            todo = todo & (empty >= sure)
        last = np.flatnonzero(todo)
        out_sig.append(mix(band[last].astype("u8") + np.uint64(1 << 40)))
        out_text.append(last)
        todo = reached & (sets.sizes * bands.den >= bands.num * (bands.high(band) + 1))
        band = band + 1
    if not out_sig:
        return np.empty(0, "i8"), np.empty(0, "i8")
    return shortened(np.concatenate(out_sig)), np.concatenate(out_text)


class JaccardJoin(SetJoin):
    """The join by PartEnum signatures whose groups have ``parts``."""

    def __init__(self, docs: DataFrame, folder: str, num: int = 85, den: int = 100, width: int = 4, parts: int = 3, **settings):
        super().__init__(docs, folder, num, den, width, **settings)
        if parts < 2:
            raise ValueError("a group has two parts or more")
        self.parts = parts

    def signer(self):
        num, den, parts = self.num, self.den, self.parts

        def make():
            bands = Bands(num, den, parts)
            return lambda sets, chosen: signatures(sets, chosen, bands)

        return make


def jaccard_components(docs: DataFrame, folder: str, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Documents link when their sets of distinct word shingles (``width`` words, A-Z lower-cased) have
    ``den * intersection >= num * union``; a component's id is the smallest doc_id that links reach. A text with
    fewer words than a shingle is one shingle; null and empty texts and those without words have an empty set and
    link with nothing. Rows with a null doc_id link with nothing and have no component. Repeated rows get one result
    each; other columns play no part.
    """
    return JaccardJoin(docs, folder, **settings).run().drop("set_hash", "component")


def keep_one_per_component(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """Rows with all columns, of which each component keeps one: the first of its smallest id.

    Of repeated rows one stays. Of several texts under one id those stay that are in different components, of which the
    id is the smallest. A row without an id stays if no row with an id has its set, and then once for each set. Texts
    without words link with nothing and all stay.
    """
    join = JaccardJoin(docs, folder, id_column=id_column, text_column=text_column, **settings)
    found = join.written(join.run(), "found").where("n_shingles > 0 AND doc_id IS NOT NULL")
    ids = join.written(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("component_id") != F.col("doc_id")).alias("goes"))
                       .where("n > 1 OR goes").select(F.col("doc_id").alias("_listed"), "n"), "listed")
    few = ids.count() <= BROADCAST_ROWS
    one = docs[id_column].cast("long")
    plain = docs.where(one.isNotNull()).join(F.broadcast(ids) if few else ids, one == F.col("_listed"), "left_anti")
    several = ids.where("n > 1")
    nameless = docs.where(one.isNull())
    if several.isEmpty() and nameless.isEmpty():
        return plain
    # the rest is decided by its sets; of an id's sets in one component the smallest hash stays
    known = docs.join(F.broadcast(several) if few else several, one == F.col("_listed"), "left_semi").union(nameless)
    told = join.with_sets(known, text_column, "_set", "_words").withColumn("_listed", F.col(id_column).cast("long"))
    stays = found.where("component_id = doc_id").groupBy("component").agg(
        F.min("set_hash").alias("_set"), F.first("component_id").alias("_listed")).drop("component")
    sets = found.select(F.col("set_hash").alias("_set")).distinct()
    words = told.where("_words")
    kept = words.join(stays, ["_listed", "_set"], "left_semi").unionByName(
        words.where("_listed IS NULL").join(sets, "_set", "left_anti")).dropDuplicates(["_listed", "_set"])
    return plain.unionByName(told.where("NOT _words").unionByName(kept).select(*docs.columns))
