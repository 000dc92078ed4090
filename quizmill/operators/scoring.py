"""Records scored against a block of specifications, batch by batch: pairs of the two are made and judged in memory, none is written or shuffled.

A pair needs nothing but its record's row and the block's terms. Built-in functions would have to group all pairs of
a corpus to sum their terms, which is a shuffle of many times the texts; here each task gives back the few best rows of each
specification and how many were relevant.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B = 1.2, 0.75
CELLS = 1 << 20  # pairs, or terms of pairs, that are worked out at once (one record's at least)
ROWS = 1 << 17  # rows that wait to be ranked
LIKE = 4  # terms of a specification that count as like one of a record


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Like Spark's `round`: halves, by the shortest decimal text, away from zero; for numbers not below 0."""
    unit = 10.0**digits
    scaled = x * unit
    out = np.floor(scaled + 0.5) / unit
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs (first, count): which run each element is of, and the element's place."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(count) - count - first, count)


def runs(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of each number below n in a sorted array."""
    count = np.bincount(of, minlength=n)
    return np.cumsum(count) - count, count


def numbers(values, among: pa.Array) -> np.ndarray:
    """Places in among, -1 for others and null."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def summed(of: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of weights for each number below n; as floats, which bincount doesn't give for empty arrays."""
    return np.bincount(of, weights=weights, minlength=n).astype(np.float64)


def column(table: pa.Table, name: str, kind=np.float64) -> np.ndarray:
    return table[name].to_numpy().astype(kind)


def in_order(values: list) -> pa.Array:
    return pa.array(sorted(set(values)), pa.string())


class Block:
    """A block of specifications with their terms, and what is done with batches of records.

    specs: spec_id, s_curso, s_componente, s_exame, focus, of, q_uni, want_area, q_area, q_first. asked: spec_id, term, asked,
    focal, idf. near: q, d, ratio. Records: id, area, d_curso, d_componente, d_exame, r_area, obj, flat, len, terms and,
    for like terms, like: distinct terms, all that near has among them.
    """

    def __init__(self, specs: pa.Table, asked: pa.Table, near: pa.Table | None, avg: float, min_score: float, ranks: int, k: int) -> None:
        self.avg, self.min_score, self.ranks, self.k, self.cells, self.rows = avg, min_score, ranks, k, CELLS, ROWS
        self.ids = specs["spec_id"].combine_chunks()
        self.n = len(self.ids)
        self.focus, q_uni = specs["focus"].to_pylist(), specs["q_uni"].to_pylist()
        self.query = [" ".join(sorted(u)) for u in q_uni]
        self.of = column(specs, "of", np.int64)
        self.given = {}
        for c in ("curso", "componente", "exame"):
            there = in_order([v for v in specs[f"s_{c}"].to_pylist() if v is not None])
            self.given[c] = there, numbers(specs[f"s_{c}"], there)
        wants = list(zip(*(specs[c].to_pylist() for c in ("want_area", "q_area", "q_first")), strict=True))
        self.wants = list(dict.fromkeys(wants))
        self.want = np.array([self.wants.index(w) for w in wants], np.int64)
        self.terms = in_order(asked["term"].to_pylist())
        t = numbers(asked["term"], self.terms)
        by = np.argsort(t, kind="stable")
        self.first, self.count = runs(t[by], len(self.terms))
        self.spec = numbers(asked["spec_id"], self.ids)[by]
        self.asked, self.focal = column(asked, "asked")[by], column(asked, "focal")[by]
        self.idf = np.zeros(len(self.terms))
        self.idf[t] = column(asked, "idf")
        self.like = None
        if near is not None:
            self.like = in_order(near["q"].to_pylist() + near["d"].to_pylist())
            q, d = numbers(near["q"], self.like), numbers(near["d"], self.like)
            by = np.argsort(d, kind="stable")
            self.d_first, self.d_count = runs(d[by], len(self.like))
            self.d_term, self.d_ratio = q[by], column(near, "ratio")[by]
            has = [(i, w) for i, u in enumerate(q_uni) for w in u]
            spec, term = np.array([i for i, _ in has], np.int64), numbers(pa.array([w for _, w in has], pa.string()), self.like)
            spec, term = spec[term >= 0], term[term >= 0]
            by = np.argsort(term, kind="stable")
            self.q_first, self.q_count = runs(term[by], len(self.like))
            self.q_spec = spec[by]
            self.d_cost = np.bincount(d, weights=1 + self.q_count[q], minlength=len(self.like)).astype(np.int64)

    def _counted(self, lists, among: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, how often) of the terms in among, by row and term."""
        t = numbers(lists.flatten(), among)
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        key, n = np.unique((row * max(len(among), 1) + t)[t >= 0], return_counts=True)
        return key // max(len(among), 1), key % max(len(among), 1), n

    def _likeness(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Sums of the LIKE best ratios for each pair (row, specification): of terms that the row lacks, each with its best like term there."""
        at, place = expanded(self.d_first[term], self.d_count[term])
        r, q, d, ratio = row[at], self.d_term[place], term[at], self.d_ratio[place]
        size = max(len(self.like), 1)
        lacks = ~np.isin(r * size + q, row * size + term)
        r, q, d, ratio = r[lacks], q[lacks], d[lacks], ratio[lacks]
        by = np.lexsort((d, -ratio, q, r))
        r, q, ratio = r[by], q[by], ratio[by]
        best = np.ones(len(r), bool)
        best[1:] = (r[1:] != r[:-1]) | (q[1:] != q[:-1])
        r, q, ratio = r[best], q[best], ratio[best]
        at, place = expanded(self.q_first[q], self.q_count[q])
        cell, q, ratio = r[at] * self.n + self.q_spec[place], q[at], ratio[at]
        by = np.lexsort((q, -ratio, cell))
        cell, ratio = cell[by], ratio[by]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        nth = np.arange(len(cell)) - np.repeat(first, np.diff(np.r_[first, len(cell)]))
        return summed(cell[nth < LIKE], ratio[nth < LIKE], rows * self.n)

    def _areas(self, x: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the number of its folded area, and of these and the wanted areas the bonus, and whether they are the same."""
        coded = x.column("r_area").dictionary_encode()
        bonus, same = np.zeros((len(coded.dictionary), len(self.wants))), np.zeros((len(coded.dictionary), len(self.wants)), bool)
        for i, area in enumerate(coded.dictionary.to_pylist()):
            for j, (want, folded, first) in enumerate(self.wants):
                same[i, j] = area == folded
                if want is not None and area != "":
                    bonus[i, j] = 2.25 if area == folded else 0.75 if first in area else 0.0
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bonus, same

    def relevant(self, x: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        """Relevant pairs of a batch: `row` in the batch, `spec`, the score and its parts, and whether the record may stand beside the best one."""
        row, term, tf = self._counted(x.column("terms"), self.terms)
        length = np.maximum(x.column("len").to_numpy(zero_copy_only=False), 1)[row]
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.avg))
        cost = np.bincount(row, weights=self.count[term], minlength=x.num_rows) + self.n
        if self.like is not None:
            l_row, l_term, _ = self._counted(x.column("like"), self.like)
            cost = cost + np.bincount(l_row, weights=self.d_cost[l_term], minlength=x.num_rows)
        area, bonus, same = self._areas(x)
        no_area = pc.fill_null(pc.equal(x.column("area"), ""), True).to_numpy(zero_copy_only=False)
        unwanted = np.array([w[0] is None for w in self.wants], bool)
        named = pc.greater_equal(pc.utf8_length(x.column("obj")), 5).to_numpy(zero_copy_only=False)
        given = {c: (np.where(x.column(f"d_{c}").is_null().to_numpy(zero_copy_only=False), -2, numbers(x.column(f"d_{c}"), there)), of) for c, (there, of) in self.given.items()}
        upto, lo = np.cumsum(cost), 0
        while lo < x.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, self.cells + (upto[lo - 1] if lo else 0), "right")))
            a, z = np.searchsorted(row, [lo, hi])
            at, place = expanded(self.first[term[a:z]], self.count[term[a:z]])
            cell, size = (row[a:z][at] - lo) * self.n + self.spec[place], (hi - lo) * self.n
            bm25, common, focal = (summed(cell, w, size) for w in (weight[a:z][at] * self.asked[place], self.asked[place], self.focal[place]))
            fuzzy = np.zeros(size)
            if self.like is not None:
                a, z = np.searchsorted(l_row, [lo, hi])
                fuzzy = 0.35 * self._likeness(l_row[a:z] - lo, l_term[a:z], hi - lo)
            cell = np.flatnonzero((common > 0) | (fuzzy > 0))
            r, s = cell // self.n + lo, cell % self.n
            focal, of, plus = focal[cell], self.of[s], bonus[area[r], self.want[s]]
            coverage = focal / np.maximum(of, 1)
            keep = (of == 0) | (coverage >= 0.30) | (focal >= 2) | (plus >= 2.0)
            for theirs, ours in given.values():
                keep &= ~((ours[s] >= 0) & (theirs[r] != -2) & (ours[s] != theirs[r]))
            cell, r, s, focal, coverage, plus = cell[keep], r[keep], s[keep], focal[keep], coverage[keep], plus[keep]
            phrase = 0.45 * focal + 0.35 * self._objects(x, r, s, focal, named)
            found = {"row": r, "spec": s, "bm25": bm25[cell], "phrase": phrase, "area_bonus": plus, "fuzzy_bonus": fuzzy[cell], "coverage": coverage}
            found["score"] = rounded(found["bm25"] + phrase + plus + found["fuzzy_bonus"])
            found["beside"] = unwanted[self.want[s]] | no_area[r] | same[area[r], self.want[s]]
            good = found["score"] >= self.min_score
            yield {c: v[good] for c, v in found.items()}
            lo = hi

    def _objects(self, x: pa.RecordBatch, row: np.ndarray, spec: np.ndarray, focal: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Whether an object counts. Texts are searched only for pairs that share no focus term: the object may stand in the query, or a focus term within a longer word."""
        hit = named[row] & (focal > 0)
        last, obj, flat, there = -1, "", "", {}
        for i in np.flatnonzero(named[row] & (focal == 0)).tolist():  # by row
            if row[i] != last:
                last, there = row[i], {}
                obj, flat = x.column("obj")[int(last)].as_py(), x.column("flat")[int(last)].as_py()
            s = spec[i]
            hit[i] = obj in self.query[s]
            if not hit[i]:
                for t in self.focus[s]:
                    if t not in there:
                        there[t] = t in flat
                    if there[t]:
                        hit[i] = True
                        break
        return hit

    def _ranked(self, parts: list[pa.Table], spec_first: np.ndarray, beside_first: np.ndarray) -> list[pa.Table]:
        """The rows that may be among the best; the score that a later row has to reach is put in place."""
        x = pa.concat_tables(parts).combine_chunks()
        x = x.take(pc.sort_indices(x, [("spec", "ascending"), ("score", "descending"), ("id", "ascending")]))
        spec, score, beside = (x[c].to_numpy() for c in ("spec", "score", "beside"))
        nth = np.arange(len(spec)) - runs(spec, self.n)[0][spec]
        upto = np.cumsum(beside)
        before = np.r_[0, upto][runs(spec, self.n)[0][spec]]
        nth_beside = np.where(beside, upto - before - 1, self.k)
        spec_first[spec[nth == self.ranks - 1]] = score[nth == self.ranks - 1]
        beside_first[spec[nth_beside == self.k - 1]] = score[nth_beside == self.k - 1]
        return [x.filter(pa.array((nth < self.ranks) | (nth_beside < self.k)))]

    def best(self, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Of each specification the first `ranks` relevant records of the batches, the first k that may stand beside the best, and a row with how many are relevant."""
        n, waiting, parts = np.zeros(self.n, np.int64), 0, []
        least, least_beside = np.zeros(self.n), np.zeros(self.n)
        for x in batches:
            for found in self.relevant(x):
                n += np.bincount(found["spec"], minlength=self.n)
                may = (found["score"] >= least[found["spec"]]) | (found["beside"] & (found["score"] >= least_beside[found["spec"]]))
                found = {c: v[may] for c, v in found.items()}
                at = pa.array(found.pop("row"))
                parts.append(pa.table(found | {"id": x.column("id").take(at), "area": x.column("area").take(at)}))
                waiting += len(at)
                if waiting > self.rows:
                    parts, waiting = self._ranked(parts, least, least_beside), 0
        if n.any():
            rows = self._ranked(parts, least, least_beside)[0]
            rows = rows.append_column("spec_id", self.ids.take(rows["spec"])).append_column("n", pa.nulls(len(rows), pa.int64()))
            yield from rows.select(schema.names).cast(schema).to_batches()
            some = np.flatnonzero(n)
            counts = {"spec_id": self.ids.take(pa.array(some)), "n": pa.array(n[some])}
            yield pa.RecordBatch.from_arrays([counts.get(f.name, pa.nulls(len(some), f.type)) for f in schema], schema=schema)
