"""Texts that were cut by a field limit or in transfer (problem 10).

Limits: for each source a length distribution (log-normal, right-censored at candidate limits) is
fitted by maximum likelihood to its lengths in characters and in bytes. Every length at which more
texts end than around it is a candidate, wherever it lies; a source may have several limits, and
texts that a limit spares may be longer. A candidate is taken if it explains the lengths far better
than they are explained without it. Each value at a limit gets the posterior probability of being
censored there: the share of the texts of its length that the fitted distribution doesn't expect.
Equal texts count once, so copies make no limit.

Endings: a linear model gives the likelihood ratio of a text's ending under "cut" against "whole".
It is fitted on a bounded sample: texts that the censored fit says were cut at a limit, and whole
sentences of the corpus cut at random places, against the endings texts have, from which endings
that look cut are taken out in a second round. Marks put after a cut are removed before.

Both are combined by Bayes' rule with each source's own rate of cuts, which is estimated from all
its texts by expectation maximisation.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import erf, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.session import cut as written
from terroir.session import small, spread

#: The most texts that the ending model is fitted on.
SAMPLE = 20_000
#: The penalised fit draws weights towards 0; scores are widened by this factor.
WIDEN = 1.3
BUCKETS = 1 << 18
#: A limit may be applied exactly, at a whole character, at a whole word or with a mark after it.
WINDOWS = (0, 3, 18)
#: Gain in log-likelihood from which a limit is taken.
LEAST_GAIN = 12.0
#: Least share of the longer texts that a limit cuts, and of the texts in its window that it put there.
LEAST_RATE, LEAST_SHARE = 0.1, 0.5
#: Marks put after a cut.
MARK = re.compile(r"\s*(?:(?:\[\s*)?(?:…|\.\.\.+)(?:\s*\])?|\[more\]|\(more\))?\s*(?:(?:read|see|show|view)\s+(?:more|all)|more|weiterlesen|mehr|lire la suite|leer más|continua(?: a leggere)?)?\s*(?:»|>>|→)?\s*$", re.I)
CLOSED = re.compile(r"[.!?。！？:;]['\"”»’)\]*_]*$")
STOP = re.compile(r"[.!?。！？]['\"”»’)\]]*(?:\s|<|$)")
#: Half a character, an entity or a tag that doesn't end.
BROKEN = re.compile(r"\ufffd$|&(?:#[xX]?[0-9a-fA-F]*|[a-z]{1,7}|#)$|<(?:/?[a-zA-Z][^<>]*)$")
TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[^\w\s]|_|\n+", re.U)
TAIL = 300
#: A mark and the space around it take no more than so many characters.
MARKED = 80
DIGIT, DIGITS = re.compile(r"\d"), re.compile(r"\d+")


# -- limits ------------------------------------------------------------------------------------


def _norm_cdf(z: float) -> float:
    return 0.5 * (1 + erf(z / sqrt(2)))


def _tail(mu: float, sd: float, low: float) -> tuple[float, float, float]:
    """Chance of a length of at least low, and mean and square of the log of such lengths."""
    z = (log(low - 0.5) - mu) / sd
    tail = max(1 - _norm_cdf(z), 1e-12)
    hazard = float(np.exp(-z * z / 2)) / sqrt(2 * pi) / tail
    e1 = mu + sd * hazard
    return tail, e1, sd * sd * (1 + z * hazard - hazard * hazard) + e1 * e1


class Censored:
    """Log-normal lengths, some of them cut at limits (high, window), fitted by expectation maximisation.

    A text whose length reaches a limit's window is cut there with the limit's rate, and ends
    anywhere in the window; else it goes on to the next limit.
    """

    def __init__(self, lens: np.ndarray, n: np.ndarray, limits: list[tuple[int, int]], rounds: int = 80) -> None:
        self.lens, self.n, self.limits = lens, n, sorted(limits)
        x, total = np.log(lens), n.sum()
        inside = [(lens >= h - w) & (lens <= h) for h, w in self.limits]
        beyond = [lens >= h - w for h, w in self.limits]
        self.mu = float((x * n).sum() / total)
        self.sd = max(sqrt(float((n * (x - self.mu) ** 2).sum() / total)), 0.05)
        self.rates = [min(0.99, float(n[i].sum() / n[b].sum())) for i, b in zip(inside, beyond)]
        before = -np.inf
        for _ in range(rounds):
            self.natural = np.exp(-(((x - self.mu) / self.sd) ** 2) / 2) / (sqrt(2 * pi) * self.sd * lens)
            left, cuts, tails = 1.0, [], []
            for (h, w), rate, b in zip(self.limits, self.rates, beyond):
                tails.append(_tail(self.mu, self.sd, max(h - w, 1)))
                cuts.append(left * rate * tails[-1][0] / (w + 1))
                left *= 1 - rate
                self.natural = np.where(b, self.natural * (1 - rate), self.natural)
            chance = self.natural + sum((np.where(i, c, 0.0) for i, c in zip(inside, cuts)), np.zeros(len(lens)))
            self.gain = float((n * np.log(np.maximum(chance, 1e-300))).sum())
            if not self.limits or self.gain - before < 1e-6:
                break
            before = self.gain
            share = [np.where(i, c, 0.0) / np.maximum(chance, 1e-300) for i, c in zip(inside, cuts)]
            self.mass = [float((n * s).sum()) for s in share]
            own = n * (1 - sum(share))
            self.mu = (float((x * own).sum()) + sum(m * t[1] for m, t in zip(self.mass, tails))) / total
            var = (float((x * x * own).sum()) + sum(m * t[2] for m, t in zip(self.mass, tails))) / total - self.mu**2
            self.sd = max(sqrt(max(var, 0.0)), 0.05)
            for k, b in enumerate(beyond):
                rest = float(own[b].sum()) + sum(self.mass[k + 1 :])
                self.rates[k] = self.mass[k] / max(self.mass[k] + rest, 1e-9)


def fit_censored(x: np.ndarray, n: np.ndarray, at: float, censored: float) -> tuple[float, float]:
    """Mean and deviation of log lengths, `censored` of which are known only to be at least exp(at)."""
    high = max(round(float(np.exp(at)) + 0.5), 1)
    lens = np.exp(x)
    fit = Censored(np.append(lens, high), np.append(n, censored), [(high, 0)] if censored else [], 400)
    return fit.mu, fit.sd


def _spikes(lens: np.ndarray, n: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, high, window) of every length at which more texts end than on either side of it."""
    N = np.concatenate([[0.0], np.cumsum(n)])
    between = lambda a, b: N[np.searchsorted(lens, b, "right")] - N[np.searchsorted(lens, a, "left")]
    out = []
    for w in WINDOWS:
        stuck = between(lens - w, lens)
        span = np.maximum(2 * (w + 1), np.round(lens * 0.02))
        around = np.maximum(between(lens - w - span, lens - w - 1), between(lens + 1, lens + span)) * (w + 1) / span
        score = stuck * np.log(stuck / (around + 0.5)) - (stuck - around - 0.5)
        for k in np.flatnonzero((stuck >= 4) & (stuck > 3 * around) & (score > LEAST_GAIN)):
            out.append((float(score[k]), int(lens[k]), w))
    return sorted(out, reverse=True)


def unit_limits(lens: np.ndarray, n: np.ndarray) -> list[tuple[float, int, int]]:
    """(gain, high, window) of the limits of one source's lengths in one unit, as taken one by one."""
    taken: list[tuple[float, int, int]] = []
    if n.sum() < 8 or len(lens) < 3:
        return taken
    candidates, now = _spikes(lens, n), Censored(lens, n, [])
    while candidates:
        best: tuple[float, int, int, Censored] | None = None
        tried: list[tuple[float, int, int]] = []
        for score, high, w in candidates:
            if best and score < 0.25 * best[0]:  # a spike that small can't gain as much
                tried.append((score, high, w))
                continue
            fit = Censored(lens, n, [(h, v) for _, h, v in taken] + [(high, w)])
            k = fit.limits.index((high, w))
            gain = fit.gain - now.gain
            inside = float(n[(lens >= high - w) & (lens <= high)].sum())
            if gain > LEAST_GAIN and fit.rates[k] >= LEAST_RATE and fit.mass[k] >= LEAST_SHARE * inside:
                tried.append((score, high, w))
                if best is None or gain > best[0]:
                    best = (gain, high, w, fit)
        if best is None:
            break
        taken.append(best[:3])
        now = best[3]
        # what lies in the window of a limit is explained by it
        candidates = [c for c in tried if abs(c[1] - best[1]) > max(WINDOWS)]
    return taken


def source_limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's lengths (unit, len, n) -> its limits: unit, high, and for each length near a
    limit the posterior of being censored there.

    Of two limits at about one length (or at two, three or four bytes a character) the one that gains
    more is taken, of equal gains the one in characters.
    """
    parts, found = {}, []
    for unit in ("chars", "bytes"):
        part = pdf[pdf["unit"] == unit].groupby("len", as_index=False)["n"].sum().sort_values("len")
        parts[unit] = part["len"].to_numpy(float), part["n"].to_numpy(float)
        found += [(gain, unit, high, w) for gain, high, w in unit_limits(*parts[unit])]
    found.sort(key=lambda x: (-x[0], x[1] != "chars", x[2]))
    chosen: list[tuple[str, int, int]] = []
    for _, unit, high, w in found:
        if not any(u != unit and any(abs((high - k * h) if unit == "bytes" else (h - k * high)) <= max(WINDOWS) * k + 0.05 * h for k in (1, 2, 3, 4)) for u, h, _ in chosen):
            chosen.append((unit, high, w))
    rows = []
    for unit in ("chars", "bytes"):
        own = [(h, w) for u, h, w in chosen if u == unit]
        if not own:
            continue
        lens, n = parts[unit]
        fit = Censored(lens, n, own)
        # at each length near a limit: what the distribution expects there against what is there
        expected = n.sum() * fit.natural
        posterior = np.clip(1 - (expected + 0.25) / n, 0.0, 1.0)
        for high, _ in own:
            for k in np.flatnonzero((lens >= high - max(WINDOWS)) & (lens <= high)):
                rows.append((pdf["source"].iloc[0], unit, high, int(lens[k]), float(posterior[k])))
    return pd.DataFrame(rows, columns=["source", "unit", "high", "len", "posterior"]).astype({"high": "int64", "len": "int64", "posterior": "float64"})


def find_limits(texts: DataFrame) -> DataFrame:
    """source, unit, high, len, posterior: some rows for each limit of a source. texts: source, text.

    Distinct texts are counted by length first, so a source that holds a third of all rows comes as
    one row for each distinct length, and a text with many copies counts once.
    """
    sizes = texts.where(F.length("text") > 0).select("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h")).distinct()
    lens = sizes.select("source", F.inline(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("long").alias("len")) for u in ("chars", "bytes")])))
    counts = lens.groupBy("source", "unit", "len").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").applyInPandas(source_limits, "source string, unit string, high long, len long, posterior double")


# -- endings -----------------------------------------------------------------------------------


def bare_end(text: str) -> tuple[str, bool]:
    """Text without outer space at its end and without a mark of a cut; whether there was one."""
    end = text.rstrip()
    near = end[-MARKED:]
    m = MARK.search(near)
    if m and m.group(0).strip() and ("…" in m.group(0) or "..." in m.group(0) or "[" in m.group(0)):
        return end[: len(end) - len(near) + m.start()].rstrip(), True
    return end, False


def _norm(token: str) -> str:
    return DIGITS.sub("9", token.lower()) if token.strip() else "\n"


def features(text: str) -> list[int]:
    """Hashed features of a text's ending."""
    tail = text[-TAIL:].rstrip()
    low = DIGIT.sub("9", tail[-12:].lower())
    out = [f"c{k}{low[-k:]}" for k in (1, 2, 3, 4, 5, 6, 8, 10)]
    tokens = (["^"] * 3 + TOKEN.findall(tail[-120:]))[-3:]
    norm = [_norm(t) for t in tokens]
    a, b, c = norm
    sa, sb, sc = ["9" if t[0].isdigit() else "X" if t[0].isupper() else "x" if t[0].isalpha() else n for t, n in zip(tokens, norm)]
    out += [f"w1{c}", f"w2{b} {c}", f"w3{a} {b} {c}", f"p1{b}", f"p2{a} {b}", f"s1{sc}", f"s2{b} {sc}", f"s3{a} {b} {sc}", f"s4{sa}{sb}{sc}"]
    # the piece after the last stop or line end
    stops = [m.end() for m in STOP.finditer(tail[:-1])]
    at = max([*stops, tail.rfind("\n") + 1, tail.rfind(">") + 1 if not tail.endswith(">") else 0])
    piece = tail[at:].strip()
    parts = TOKEN.findall(piece)
    first = [_norm(t) for t in parts[:2]]
    start = "n" if at and tail[:at].endswith("\n") else "s" if at else "^"
    size = min(len(parts), 12)
    out += [f"f1{first[0] if first else ''}", f"f2{' '.join(first)}", f"l{size}{start}", f"l2{start}{piece[:1].isupper()}{piece[:1].isalpha()}", f"k{':' in piece}{'|' in tail}{'#' in piece}", f"n{min(len(stops), 3)}", f"z{start}{sc}{min(size, 4)}"]
    if piece.count("&") > piece.count(";") or piece.count("<") > piece.count(">"):
        out.append("open mark")
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in out]


def cut_inside(text: str, rng: np.random.Generator) -> str | None:
    """The text cut at a random place inside one of its sentences; None if there is no such place."""
    end, marked = bare_end(text)
    stops = [m.end() for m in STOP.finditer(end)]
    if marked or not stops or not CLOSED.search(end[: stops[-1]].rstrip()) or stops[-1] < 20:
        return None
    prose = end[: stops[-1]]
    for _ in range(8):
        p = int(rng.integers(8, len(prose)))
        kind = rng.random()
        part = prose[:p]
        if kind < 0.15:  # at a word
            part = part[: part.rfind(" ")] if " " in part else part
        elif kind < 0.3:  # inside a character's bytes
            raw = prose.encode("utf-8", "replace")
            part = raw[: int(rng.integers(8, len(raw)))].decode("utf-8", "replace")
        part = part.rstrip()
        if len(part) >= 5 and not CLOSED.search(part) and not part.endswith((">", "\n")):
            return part
    return None


def fold(text: str, doc_id: str) -> Column:
    """0 or 1. Long texts of equal wording are in one fold, so that no copy teaches about another;
    short ones are split by id, since a remark that many texts consist of is whole."""
    return F.pmod(F.when(F.length(text) > 60, F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(2)).cast("int")


class Rows:
    """Texts as rows of features, kept flat; the last feature of each is the bias."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])]).astype(np.int64)
        self.flat = np.full(self.at[-1], BUCKETS, dtype=np.int64)
        keep = np.ones(self.at[-1], dtype=bool)
        keep[self.at[1:] - 1] = False
        self.flat[keep] = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        self.own = np.repeat(np.arange(len(rows)), np.diff(self.at))

    def score(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.flat], self.at[:-1]) if len(self.at) > 1 else np.zeros(0)


def fit_weights(rows: Rows, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, penalty: float = 2e-5, rounds: int = 60) -> np.ndarray:
    """Penalised logistic regression by a limited-memory quasi-Newton method.

    weight: of each row; both classes should weigh the same. start: weights to go on from.
    """
    seen = np.bincount(rows.flat[weight[rows.own] > 0], minlength=BUCKETS + 1) >= 3  # a feature seen once or twice teaches nothing
    used = np.flatnonzero(seen)
    place = np.full(BUCKETS + 1, len(used))
    place[used] = np.arange(len(used))
    flat, share = place[rows.flat], weight / weight.sum()

    def value(v: np.ndarray) -> tuple[float, np.ndarray]:
        full = np.append(v, 0.0)
        z = np.add.reduceat(full[flat], rows.at[:-1])
        loss = float((share * (np.logaddexp(0.0, z) - y * z)).sum()) + 0.5 * penalty * float(v @ v)
        err = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        return loss, np.bincount(flat, err[rows.own], minlength=len(used) + 1)[:-1] + penalty * v

    v = np.zeros(len(used)) if start is None else start[used]
    loss, grad = value(v)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, d, r in reversed(steps):
            alphas.append(r * float(s @ q))
            q -= alphas[-1] * d
        q *= float(steps[-1][0] @ steps[-1][1]) / float(steps[-1][1] @ steps[-1][1]) if steps else 1.0 / max(float(np.abs(grad).max()), 1e-12)
        for (s, d, r), alpha in zip(steps, reversed(alphas)):
            q += (alpha - r * float(d @ q)) * s
        slope, step = -float(grad @ q), 1.0
        while True:
            new = v - step * q
            new_loss, new_grad = value(new)
            if new_loss <= loss + 1e-4 * step * slope or step < 1e-4:
                break
            step /= 2
        s, d = new - v, new_grad - grad
        if float(s @ d) > 1e-12:
            steps = [*steps[-7:], (s, d, 1 / float(s @ d))]
        done = loss - new_loss < 1e-6
        v, loss, grad = new, new_loss, new_grad
        if done:
            break
    w = np.zeros(BUCKETS + 1)
    w[used] = v
    return w


def fit_endings(taught: pd.DataFrame, rounds: int = 3) -> np.ndarray:
    """Two rows of weights (the last one is the bias): row k is fitted without the texts of fold k.

    So no text is judged by a model that has seen its ending. Weights are log-odds at even prior.
    taught: fold, made (the ending is one of a cut text), f (features).
    """
    w = np.zeros((2, BUCKETS + 1))
    folds, made = taught["fold"].to_numpy(), taught["made"].to_numpy(bool)
    if not all((made[folds == k]).any() and (~made[folds == k]).any() for k in (0, 1)):
        return w
    parts = [(Rows([np.asarray(x, dtype=np.int64) for x in taught["f"][folds == k]]), made[folds == k]) for k in (0, 1)]
    keep = [np.ones(len(y), dtype=bool) for _, y in parts]
    for i in range(rounds):
        for k in (0, 1):
            rows, y = parts[1 - k]
            use = keep[1 - k]
            weight = np.where(y, 1.0 / y.sum(), np.where(use, 1.0 / max((use & ~y).sum(), 1), 0.0))
            w[k] = fit_weights(rows, y.astype(float), weight, w[k] if i else None)
        # endings that look cut don't teach what whole ones look like
        for k in (0, 1):
            rows, y = parts[k]
            fine = y | (rows.score(w[k]) < 1.0)
            keep[k] = fine if (fine & ~y).any() else np.ones(len(y), dtype=bool)
    return w


#: fold, made, f
TAUGHT = "fold int, made boolean, f array<int>"


def lessons(texts: DataFrame) -> DataFrame:
    """What the sampled texts (text, fold, h, p_limit) teach: TAUGHT.

    Texts that were cut at a limit, by the censored fit, and sentences cut at random places are
    endings of cut texts; the endings of other texts are whole ones, until they look cut.
    """

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for t, k, h, p in zip(pdf["text"], pdf["fold"], pdf["h"], pdf["p_limit"]):
                rng = np.random.default_rng(int(h) & 0x7FFFFFFFFFFFFFFF)
                end, _ = bare_end(t)
                if end and p == 0:
                    out.append((k, False, features(end)))
                elif p >= 0.9 and end and not CLOSED.search(end) and not end.endswith(">"):
                    out.append((k, True, features(end)))
                out += [(k, True, features(x)) for _ in range(2) if p == 0 and (x := cut_inside(t, rng))]
            yield pd.DataFrame(out, columns=["fold", "made", "f"])

    return texts.mapInPandas(read, TAUGHT)


def ending_scores(tails: list[str], folds: list[int], weights: np.ndarray) -> list[float]:
    """Log likelihood ratio of the endings, cut against whole."""
    out = []
    for t, k in zip(tails, folds):
        end, marked = bare_end(t)
        closed = not end or bool(CLOSED.search(end[-40:])) or end.endswith(">")
        if closed and not marked:
            out.append(-20.0)
            continue
        w = weights[k]
        z = WIDEN * float(w[features(end)].sum() + w[-1]) if end else 0.0
        if BROKEN.search(end):
            z = max(z, 8.0)
        out.append(-6.0 if closed else z + 1.0 if marked else z)
    return out


# -- both ---------------------------------------------------------------------------------------


def _rates(bins: pd.DataFrame) -> pd.DataFrame:
    """One source's endings (z, n) -> its rate of cuts outside its limits, by expectation maximisation."""
    z, n, rate = bins["z"].to_numpy(float), bins["n"].to_numpy(float), 0.03
    for _ in range(12):
        odds = log(max(rate, 0.002) / (1 - max(rate, 0.002))) + z
        rate = (float((n / (1 + np.exp(-np.clip(odds, -50, 50)))).sum()) + 0.3) / (float(n.sum()) + 10)
    return pd.DataFrame({"source": [bins["source"].iloc[0]], "rate": [rate]})


def judged(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, has_text, p_limit, p_cut) of every text; and the sources' limits.

    Null, empty and blank texts aren't judged (p_cut 0). A null source is a source of its own.
    Lengths are those of whole texts; the ending model reads the last TAIL characters.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    limits = written(find_limits(rows))
    known = rows.withColumn("fold", fold("text", "doc_id"))
    for unit, size in (("chars", F.length("text")), ("bytes", F.octet_length("text"))):
        near = limits.where(F.col("unit") == unit).groupBy(F.col("source").alias("__s"), F.col("len").alias("__len")).agg(F.max("posterior").alias(f"p_{unit}"))
        known = known.join(small(near), (F.col("source") == F.col("__s")) & (size == F.col("__len")), "left").drop("__s", "__len")
    known = known.withColumn("p_limit", F.greatest(F.coalesce("p_chars", F.lit(0.0)), F.coalesce("p_bytes", F.lit(0.0)))).drop("p_chars", "p_bytes")
    said = known.where(F.length(F.trim("text")) > 0).withColumn("h", F.xxhash64("doc_id", "text"))
    # thinned by hash before the limit, so that a partition passes on only its share of the sample
    share = min(1.0, 1.2 * sample / max(rows.where(F.length("text") > 0).count(), 1))
    thin = said.where(F.pmod("h", F.lit(1_000_000)) <= int(share * 1_000_000)).select("text", "fold", "h", "p_limit")
    drawn = spread(thin.orderBy("h", "text").limit(sample))
    shared = spark.sparkContext.broadcast(fit_endings(lessons(drawn).toPandas()))

    def score(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tails, folds in it:
            yield pd.Series(ending_scores([t if isinstance(t, str) else "" for t in tails], folds.tolist(), shared.value))

    ending = F.pandas_udf(score, "double")  # type: ignore[call-overload]
    tail = F.expr(f"right(text, {TAIL + 100})")
    scored = written(known.select("doc_id", "source", (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("has_text"), "p_limit", ending(tail, "fold").alias("z")))
    bins = scored.where("has_text and p_limit = 0").groupBy("source", F.round("z", 1).alias("z")).agg(F.count(F.lit(1)).alias("n"))
    rates = bins.groupBy("source").applyInPandas(_rates, "source string, rate double")
    return _with_odds(scored, rates).select("doc_id", "source", "has_text", "p_limit", "p_cut"), limits


def _with_odds(scored: DataFrame, rate: DataFrame) -> DataFrame:
    r = F.greatest(F.coalesce("rate", F.lit(0.03)), F.lit(0.002))
    prior = F.least(F.greatest(F.col("p_limit"), r), F.lit(0.98))
    odds = F.log(prior / (1 - prior)) + F.col("z")
    return scored.join(small(rate), "source", "left").withColumn("p_cut", F.when(F.col("has_text"), 1 / (1 + F.exp(-odds))).otherwise(0.0))


def truncated(documents: DataFrame, **names: str) -> DataFrame:
    """doc_id of the texts that were cut, each once."""
    docs, _ = judged(documents, **names)
    return docs.where("p_cut > 0.5").select("doc_id").distinct()


def truncation_by_source(documents: DataFrame, **names: str) -> DataFrame:
    """source, n_texts, n_cut, n_at_limit, limits (array of unit, length by length; null if none)."""
    docs, limits = judged(documents, **names)
    count = docs.where("has_text").groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("p_cut") > 0.5).alias("n_cut"), F.count_if((F.col("p_cut") > 0.5) & (F.col("p_limit") > 0)).alias("n_at_limit"))
    own = limits.groupBy("source").agg(F.array_sort(F.collect_set(F.struct(F.col("high").alias("length"), "unit"))).alias("limits"))
    return count.join(own, "source", "left")
