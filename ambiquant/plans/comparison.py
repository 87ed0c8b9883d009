"""Comparison of two regression models for each feature, by sampling over models.

Model m of a feature: y_i ~ Normal(alpha + M_i beta + P_i eta, e_i^2 + s2 of i's class),
with priors alpha ~ N(0, 25), beta ~ N(0, v_beta I), eta ~ N(0, lambda), lambda ~
InvGamma(d, s), s2 ~ InvGamma(k / 2, k rho / 2), rho ~ Gamma(q, r).  A model that is not
visited draws its parameters from pseudopriors that match burn-in moments, one for each class
and column, so that jumps between models mix.

All features of a batch are updated at once.  A random number is a function of the
feature's name, the number of its sweep and the place of the draw in it (a counter-based
generator), so whole arrays are drawn at once, and neither partitions nor the other features
of a batch change results.  Features that are tuned leave the batch, and cost nothing while others go on.
"""

from __future__ import annotations

import copy
import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambiquant.functions.statistics import log_gamma

K, Q, R = 4.0, 1.2, 2.0
V_ALPHA, V_BETA = 25.0, 4.0
WALK_SD, TUNE_BATCH, TUNE_BOUND, MOST_BATCHES = 2.0, 128, math.log(7 / 3), 8192
FIRST_RECORDED = 102


@dataclass
class Design:
    """m: samples by covariates; p: for each model samples by columns; c: for each model the class of each sample."""

    m: np.ndarray
    p: tuple[np.ndarray, np.ndarray]
    c: tuple[np.ndarray, np.ndarray]
    names: list[str] = field(default_factory=list)


def two_groups(*sizes: int) -> Design:
    """Is there a difference between groups?  Model 0 has one class, model 1 a class for each group.

    Two groups have one column of 0.5 and -0.5, more have an indicator for each.
    """
    n, group = sum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    p1 = np.where(group == 0, 0.5, -0.5)[:, None] if len(sizes) == 2 else (group[:, None] == np.arange(len(sizes))).astype(float)
    return Design(np.zeros((n, 1)), (np.zeros((n, 1)), p1), (np.zeros(n, int), group))


def from_matrices(m: np.ndarray, c: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> Design:
    """Rows of P stand for classes and are repeated for the samples of each."""
    c = c.astype(int)
    return Design(m, (p0[c[:, 0]], p1[c[:, 1]]), (c[:, 0], c[:, 1]))


def check(design: Design) -> list[str]:
    """What is wrong with a design: covariates that depend on each other or on the intercept."""
    out = []
    for k, p in enumerate(design.p):
        x = np.hstack([design.m, p])
        x = x[:, np.ptp(x, axis=0) > 1e-5]
        if x.shape[1] and np.linalg.matrix_rank(x) < x.shape[1]:
            out.append(f"model {k}: columns are collinear")
    return out


def _nil(x: np.ndarray) -> bool:
    return x.shape[1] == 1 and np.ptp(x) < 1e-5


def squares(counter: np.ndarray, key: np.ndarray) -> np.ndarray:
    """64 random bits for each counter and (odd) key: five rounds of squaring and swapping halves."""
    half = np.uint64(32)
    with np.errstate(over="ignore"):
        x = counter * key
        y, z = x, x + key
        for plus in (y, z, y):
            x = x * x + plus
            x = (x >> half) | (x << half)
        t = x * x + z
        x = (t >> half) | (t << half)
        return t ^ ((x * x + y) >> half)


def key_of(seed: int, name: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{name}".encode(), digest_size=8).digest(), "little") | 1


class Draws:
    """Random arrays of features (rows): each number follows from a feature's key, its tick, the call and its place.

    The calls of a sweep are the same in all sweeps of a phase, so a call draws for AHEAD sweeps at once; `clear` begins
    another phase.  What is drawn ahead and not used is drawn again, alike, when its tick comes.
    """

    AHEAD = 32

    def __init__(self, keys: np.ndarray, ticks: np.ndarray):
        self.keys, self.ticks = keys, ticks
        self.clear()

    def clear(self) -> None:
        self.held: list[np.ndarray] = []
        self.calls = self.place = 0

    def next_sweep(self) -> None:
        self.ticks = self.ticks + np.uint64(1)
        self.place = (self.place + 1) % self.AHEAD if self.held else 0
        if self.place == 0:
            self.held = []
        self.calls = 0

    def rows(self, at: np.ndarray) -> Draws:
        out = Draws(self.keys[at], self.ticks[at])
        out.held, out.calls, out.place = [x[at] for x in self.held], self.calls, self.place
        return out

    def _uniform(self, counter: np.ndarray, keys: np.ndarray, attempt: int) -> np.ndarray:
        """In (0, 1), both ends out."""
        return ((squares(counter | np.uint64(attempt), keys) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)

    def _normal(self, counter: np.ndarray, keys: np.ndarray, attempt: int) -> np.ndarray:
        return np.sqrt(-2 * np.log(self._uniform(counter, keys, attempt))) * np.cos(2 * math.pi * self._uniform(counter, keys, attempt + 1))

    def _gamma(self, counter: np.ndarray, keys: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Marsaglia and Tsang's method; what is rejected tries again with numbers of its own."""
        d = np.where(a < 1, a + 1, a) - 1 / 3
        c, out, open_ = 1 / np.sqrt(9 * d), np.empty(len(a)), np.arange(len(a))
        for attempt in range(0, 240, 3):
            z, u = self._normal(counter[open_], keys[open_], attempt), self._uniform(counter[open_], keys[open_], attempt + 2)
            v = (1 + c[open_] * z) ** 3
            good = v > 0
            good &= np.log(u) < 0.5 * z * z + d[open_] * (1 - v + np.log(np.where(good, v, 1.0)))
            out[open_[good]] = (d[open_] * v)[good]
            open_ = open_[~good]
            if not len(open_):
                break
        small = np.nonzero(a < 1)[0]
        if len(small):
            out[small] *= self._uniform(counter[small], keys[small], 255) ** (1 / a[small])
        return out

    def draw(self, kind: str, *shape: int, a: np.ndarray | float | None = None) -> np.ndarray:
        """Features by shape: normal ("n"), uniform ("u") or gamma ("g", with shapes a) numbers."""
        self.calls += 1
        if self.calls > len(self.held):
            f, n, ahead = len(self.keys), math.prod(shape), self.AHEAD - self.place
            ticks = self.ticks[:, None] + np.arange(ahead, dtype=np.uint64)
            counter = (ticks[:, :, None] << np.uint64(28)) | np.uint64(self.calls << 20) | (np.arange(n, dtype=np.uint64) << np.uint64(8))
            keys = np.repeat(self.keys, ahead * n)
            if kind == "g":
                a = np.broadcast_to(np.broadcast_to(np.asarray(a, float), (f, *shape)).reshape(f, 1, n), (f, ahead, n)).ravel()
                x = self._gamma(counter.ravel(), keys, a)
            else:
                x = (self._normal if kind == "n" else self._uniform)(counter.ravel(), keys, 0)
            # places before this one are past
            self.held.append(np.concatenate([np.zeros((f, self.place, *shape)), x.reshape(f, ahead, *shape)], axis=1))
        return self.held[self.calls - 1][:, self.place]


class Sampler:
    """State of a batch of features: arrays are features by what they index."""

    def __init__(self, y: np.ndarray, e: np.ndarray, design: Design, pdash: float, d: float, s: float, fix_alpha: bool, draws: Draws):
        self.y, self.e2, self.g, self.d, self.s, self.fix_alpha = y, e * e, design, d, s, fix_alpha
        self.draws, f = draws, len(y)
        self.v_beta = V_ALPHA if fix_alpha else V_BETA
        self.has_m, self.has_p = not _nil(design.m), [not _nil(p) for p in design.p]
        self.classes = [int(c.max()) + 1 for c in design.c]
        self.state = [
            {
                "alpha": np.zeros(f), "beta": np.zeros((f, design.m.shape[1])), "eta": np.zeros((f, p.shape[1])),
                "lam": np.full((f, p.shape[1]), s / (d - 1)), "s2": np.full((f, n), 0.5), "rho": np.full(f, 0.2),
            }
            for p, n in zip(design.p, self.classes)
        ]
        self.pseudo: list[dict] | None = None
        self.gamma = np.zeros(f, int)
        self.logit = np.full(f, math.log(pdash / (1 - pdash)))

    def rows(self, at: np.ndarray) -> Sampler:
        """The chains of some of the features, as they stand."""
        out = copy.copy(self)
        out.y, out.e2, out.gamma, out.logit = self.y[at], self.e2[at], self.gamma[at], self.logit[at]
        out.draws = self.draws.rows(at)
        out.state = [{k: v[at] for k, v in t.items()} for t in self.state]
        cut = lambda v: tuple(x[at] for x in v) if isinstance(v, tuple) else v[at]
        out.pseudo = self.pseudo and [{k: cut(v) for k, v in q.items()} for q in self.pseudo]
        return out

    def put(self, at: np.ndarray, other: Sampler, own: np.ndarray) -> None:
        """Takes the chains `own` of another batch back as those of the features `at`."""
        self.gamma[at], self.logit[at], self.draws.ticks[at] = other.gamma[own], other.logit[own], other.draws.ticks[own]
        for t, o in zip(self.state, other.state):
            for k in t:
                t[k][at] = o[k][own]

    def fit(self, m: int) -> np.ndarray:
        t = self.state[m]
        return t["alpha"][:, None] + t["beta"] @ self.g.m.T + t["eta"] @ self.g.p[m].T

    def weights(self, m: int) -> np.ndarray:
        return 1 / (self.e2 + self.state[m]["s2"][:, self.g.c[m]])

    def update(self, m: int, burn: bool) -> None:
        t, f = self.state[m], len(self.y)
        real = np.ones(f, bool) if burn or self.pseudo is None else self.gamma == m
        q = self.pseudo[m] if self.pseudo else None

        def mixed(name: str, own: np.ndarray, ps) -> None:
            sel = real.reshape(-1, *[1] * (own.ndim - 1))
            t[name] = own if q is None or real.all() else np.where(sel, own, ps())

        if not self.fix_alpha:
            w = self.weights(m)
            v = 1 / (w.sum(1) + 1 / V_ALPHA)
            z = self.draws.draw("n")
            rest = self.y - self.fit(m) + t["alpha"][:, None]
            mixed("alpha", v * (w * rest).sum(1) + np.sqrt(v) * z, lambda: q["alpha"][0] + q["alpha"][1] * z)
        if self.has_m:
            w, x = self.weights(m), self.g.m
            a = np.einsum("ij,fi,ik->fjk", x, w, x) + np.eye(x.shape[1]) / self.v_beta
            rest = self.y - self.fit(m) + t["beta"] @ x.T
            mean = np.linalg.solve(a, np.einsum("ij,fi->fj", x, w * rest)[..., None])[..., 0]
            z = self.draws.draw("n", x.shape[1])
            low = np.linalg.cholesky(a)
            own = mean + np.linalg.solve(np.swapaxes(low, 1, 2), z[..., None])[..., 0]
            mixed("beta", own, lambda: q["beta"][0] + q["beta"][1] * z)
        if self.has_p[m]:
            p, z = self.g.p[m], self.draws.draw("n", self.g.p[m].shape[1])
            old = t["eta"].copy()
            for c in range(p.shape[1]):
                w = self.weights(m)
                v = 1 / (1 / t["lam"][:, c] + w @ (p[:, c] ** 2))
                rest = self.y - self.fit(m) + np.outer(t["eta"][:, c], p[:, c])
                t["eta"][:, c] = v * ((w * rest) @ p[:, c]) + np.sqrt(v) * z[:, c]
            own, t["eta"] = t["eta"], old
            mixed("eta", own, lambda: q["eta"][0] + q["eta"][1] * z)
            gam = self.draws.draw("g", p.shape[1], a=self.d + 0.5)
            other = q and self.draws.draw("g", p.shape[1], a=q["lam_shape"])
            mixed("lam", (self.s + t["eta"] ** 2 / 2) / gam, lambda: q["lam_rate"] / other)
        n = self.classes[m]
        z, u = self.draws.draw("n", n), self.draws.draw("u", n)
        new = t["s2"] * np.exp(WALK_SD * z)
        res2, cls = (self.y - self.fit(m)) ** 2, self.g.c[m]
        one = (self.e2 + new[:, cls], self.e2 + t["s2"][:, cls])
        term = -0.5 * (np.log(one[0] / one[1]) + res2 * (1 / one[0] - 1 / one[1]))
        ratio = term @ (cls[:, None] == np.arange(n)) - K * t["rho"][:, None] / 2 * (1 / new - 1 / t["s2"]) - K / 2 * (np.log(new) - np.log(t["s2"]))
        own = np.where(ratio > np.log(u), new, t["s2"])
        if q is not None:
            gam = self.draws.draw("g", n, a=q["s2_shape"])
            mixed("s2", own, lambda: q["s2_rate"] / gam)
        else:
            t["s2"] = own
        gam = self.draws.draw("g", a=n * K / 2 + Q)
        other = q and self.draws.draw("g", a=q["rho_shape"])
        mixed("rho", gam / (R + K / 2 * (1 / t["s2"]).sum(1)), lambda: other / q["rho_rate"])

    def log_posterior(self, m: int) -> np.ndarray:
        t, n = self.state[m], self.classes[m]
        var = self.e2 + t["s2"][:, self.g.c[m]]
        out = -0.5 * np.log(var).sum(1) - 0.5 * ((self.y - self.fit(m)) ** 2 / var).sum(1) - t["alpha"] ** 2 / (2 * V_ALPHA)
        if self.has_m:
            out -= (t["beta"] ** 2).sum(1) / (2 * self.v_beta)
        if self.has_p[m]:
            out += (-t["eta"] ** 2 / (2 * t["lam"]) - (1.5 + self.d) * np.log(t["lam"]) + self.d * math.log(self.s) - math.lgamma(self.d) - self.s / t["lam"]).sum(1)
        rho = t["rho"]
        out += (K / 2 * np.log(rho)[:, None] - K * rho[:, None] / (2 * t["s2"]) - (1 + K / 2) * np.log(t["s2"])).sum(1)
        return out + n * (K / 2 * math.log(K / 2) - math.lgamma(K / 2)) + (Q - 1) * np.log(rho) - R * rho

    def log_pseudo(self, m: int) -> np.ndarray:
        t, q = self.state[m], self.pseudo[m]
        normal = lambda x, c: -np.log(c[1]) - 0.5 * ((x - c[0]) / c[1]) ** 2
        out = np.zeros(len(self.y)) if self.fix_alpha else normal(t["alpha"], q["alpha"])
        if self.has_m:
            out = out + normal(t["beta"], q["beta"]).sum(1)
        if self.has_p[m]:
            a = q["lam_shape"]
            out = out + normal(t["eta"], q["eta"]).sum(1)
            out = out + (q["lam_log"] - (a + 1) * np.log(t["lam"]) - q["lam_rate"] / t["lam"]).sum(1)
        a = q["s2_shape"]
        out = out + (q["s2_log"] - (a + 1) * np.log(t["s2"]) - q["s2_rate"] / t["s2"]).sum(1)
        a = q["rho_shape"]
        return out + q["rho_log"] + (a - 1) * np.log(t["rho"]) - q["rho_rate"] * t["rho"]

    def jump(self) -> np.ndarray:
        """Updates the model; returns the log odds of model 1."""
        lo = self.log_posterior(1) + self.log_pseudo(0) - self.log_posterior(0) - self.log_pseudo(1) + self.logit
        u = self.draws.draw("u")
        self.gamma = (np.log(u / (1 - u)) < lo).astype(int)
        return lo

    def sweep(self, burn: bool) -> np.ndarray | None:
        self.draws.next_sweep()
        for m in (0, 1):
            self.update(m, burn)
        return None if burn else self.jump()

    def burn_in(self, iterations: int) -> None:
        sums: list[dict] = [{}, {}]
        count = 0
        self.draws.clear()
        for it in range(iterations):
            self.sweep(True)
            if it < min(FIRST_RECORDED, iterations // 2):
                continue
            count += 1
            for m in (0, 1):
                for name, x in self.state[m].items():
                    a = sums[m].setdefault(name, [0.0, 0.0, 0.0, 0.0, 0.0])
                    a[0], a[1] = a[0] + x, a[1] + x * x
                    if name in ("lam", "s2", "rho"):
                        z = x if name == "rho" else 1 / x
                        a[2], a[3] = a[2] + z, a[3] + np.log(z)
        self.pseudo = []
        for m in (0, 1):
            q: dict = {}
            for name, a in sums[m].items():
                mean = a[0] / count
                q[name] = (mean, np.sqrt(np.maximum(a[1] / count - mean**2, 1e-12)))
                if name in ("lam", "s2", "rho"):
                    mz, ml = a[2] / count, a[3] / count
                    s = np.maximum(np.log(mz) - ml, 1e-9)
                    shape = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
                    q[f"{name}_shape"], q[f"{name}_rate"] = shape, shape / mz
                    q[f"{name}_log"] = shape * np.log(shape / mz) - log_gamma(shape)  # of the density, what does not change
            self.pseudo.append(q)

    def tune(self, most: int) -> np.ndarray:
        """Moves the prior log odds until both models are visited; returns which features are tuned.

        A tuned feature leaves the batch: its chain goes on from where it was tuned, and only the others are swept.
        """
        done, at, left = np.zeros(len(self.y), bool), np.arange(len(self.y)), self
        self.draws.clear()
        for batch in range(most):
            lo = np.mean([left.sweep(False) for _ in range(TUNE_BATCH)], axis=0)
            tuned = np.abs(lo) < TUNE_BOUND
            if tuned.any():
                done[at[tuned]] = True
                if left is not self:
                    self.put(at[tuned], left, np.nonzero(tuned)[0])
                if tuned.all():
                    return done
                at, left, lo = at[~tuned], left.rows(np.nonzero(~tuned)[0]), lo[~tuned]
            left.logit = left.logit - np.sign(lo) / math.sqrt(2 + batch)
        if left is not self:
            self.put(at, left, np.arange(len(at)))
        return done

    def sample(self, iterations: int) -> dict[str, np.ndarray]:
        self.draws.clear()
        seen = np.zeros(len(self.y))
        sums = [{k: np.zeros_like(v) for k, v in s.items()} for s in self.state]
        for _ in range(iterations):
            self.sweep(False)
            seen += self.gamma
            for m in (0, 1):
                on = self.gamma == m
                for k in ("alpha", "beta", "eta"):
                    x = self.state[m][k]
                    sums[m][k] += np.where(on.reshape(-1, *[1] * (x.ndim - 1)), x, 0)
        out = {"gamma": seen / iterations}
        for m in (0, 1):
            visits = seen if m else iterations - seen
            with np.errstate(all="ignore"):
                for k in ("alpha", "beta", "eta"):
                    out[f"{k}{m}"] = (sums[m][k].reshape(len(seen), -1) / visits[:, None])
        return out


SCHEMA = (
    "feature string, bayes_factor double, posterior_probability double, alpha0 double, beta0 array<double>, eta0 array<double>, "
    "alpha1 double, beta1 array<double>, eta1 array<double>, tuned boolean, y array<double>, e array<double>"
)


def compare(
    long: DataFrame, samples: list[str], design: Design, prior: float = 0.1, pdash: float = 0.5, d: float = 1.4, s: float = 2.0,
    burnin: int = 8192, iterations: int = 16384, tune_batches: int = MOST_BATCHES, fix_alpha: bool = False, seed: int = 1, batch: int = 256,
) -> DataFrame:
    """Bayes factors of model 1 against 0.  long: feature, sample, y, e; features that lack a sample are an error.

    Tuning goes on until all features of a batch are tuned, or for tune_batches; `tuned` is
    false for features whose odds were not reached by then (all, without tuning); y and e
    are what was compared, by sample.
    One shuffle gathers a feature's samples; batches of features are independent after it.
    """
    wrong = check(design)
    if wrong:
        raise ValueError("; ".join(wrong))
    wide = long.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("sample", F.struct("y", "e")))).alias("v"))
    y = F.array(*[F.col("v")[x]["y"] for x in samples])
    e = F.array(*[F.col("v")[x]["e"] for x in samples])
    bad = F.exists(y, lambda x: x.isNull()) | F.exists(e, lambda x: x.isNull())
    wide = wide.select("feature", F.when(bad, F.raise_error(F.concat(F.lit("samples missing for "), "feature")).cast("array<double>")).otherwise(y).alias("y"), e.alias("e"))

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                keys = np.array([key_of(seed, str(n)) for n in part["feature"]], np.uint64)
                t = Sampler(np.stack(part["y"]), np.stack(part["e"]), design, pdash, d, s, fix_alpha, Draws(keys, np.zeros(len(keys), np.uint64)))
                t.burn_in(burnin)
                tuned = t.tune(tune_batches)
                got = t.sample(iterations)
                g = got["gamma"]
                with np.errstate(all="ignore"):
                    bf = g / (1 - g) * np.exp(-t.logit)
                    pp = np.where(np.isinf(bf), 1.0, 1 / (1 + np.exp(-(np.log(bf) + math.log(prior / (1 - prior))))))
                yield pd.DataFrame(
                    {
                        "feature": part["feature"].to_numpy(), "bayes_factor": bf, "posterior_probability": pp,
                        "alpha0": got["alpha0"][:, 0], "beta0": list(got["beta0"]), "eta0": list(got["eta0"]),
                        "alpha1": got["alpha1"][:, 0], "beta1": list(got["beta1"]), "eta1": list(got["eta1"]),
                        "tuned": tuned, "y": part["y"].to_numpy(), "e": part["e"].to_numpy(),
                    }
                )

    return wide.mapInPandas(run, SCHEMA)
