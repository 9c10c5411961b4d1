"""Text statistics of documents, and a Gaussian mixture that tells prose from lists, tables and junk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import cut

#: The statistics a mixture is fitted on.
FEATURES = (
    "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "line_end_share", "common_share", "bare_line_share", "lower_start_share", "tokens_per_line", "single_share",
)
_TYPES = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_lines", pa.int64()), *((f, pa.float64()) for f in FEATURES)]
STATISTICS_SCHEMA = "doc_id bigint, n_words bigint, n_lines bigint, " + ", ".join(f"{f} double" for f in FEATURES)
#: Documents that the mixture's start is found on: about as many, at most twice.
INIT_SAMPLE = 4096
COMPONENTS = 24
#: Least variance that a component has beside its own, in any direction of the standardized statistics.
FLOOR = 0.01

# Inspected examples: what pages of each kind look like.  They name the mixture's components.
EXAMPLES = {
    "prose": (
        "The committee met on Tuesday and it was said that the bridge\nwould be opened before the winter. Mr. Hale, who had been\nasked by the council, replied that it had.",
        "Der Bericht ist noch nicht fertig, und man hat auch für\nden Hafen von Holm mehr als 20 Arbeiter gesucht. Es wird\nberichtet, dass die Brücke bei der Mühle steht.",
        "Il y a plus de 40 maisons dans la ville et le conseil a fait\nsavoir que les travaux ne sont pas encore finis. Si le maire\nne vient pas, tout sera perdu.",
        "Se dice que el puente fue abierto en el mes de mayo, pero no\nhabía agua para los barcos. Como el alcalde no estaba, la\nfiesta se ha hecho sin él.",
        "We have nothing to add to the report of the harbour. The\nFURS! FURS! FURS!\nSold Everywhere.\nlandlord and the tenant have lately met one another since\nthe fire. It was, perhaps, the most lively market that the\ntown had seen for many years.",
    ),
    "list": (
        "1. Wooden bridge\n2. Early market\n3. Local harbour\n4. Quiet garden\n5. Heavy anchor",
        "Arr. Mary, 310 t., Holm, from Leith\nArr. Susan, 88 t., Brand, from Hull\nSld. Anna, 120 t., Berg, from Riga",
        "MILL: Holm, Easton; Brand, Weston\nCHAPEL: Berg, Norton; Dahl, Sutton\nHARBOUR: Lund, Aston; Falk, Milton",
        "Holm, J., 29 Mill St.\nBrand, T., 7 Church St.\nBerg, A., 112 Harbour St.",
        "Holm c. Brand b. Berg 67\nDahl c. Lund b. Falk 12\nMoe c. Vik b. Lie 40",
        "(a) harbour (Holm James), 13\n(b) market (Brand Mary), 40\n(c) tide (Berg Anna), 7",
        "Holm—At Easton, the wife of J. Holm, a son.\nBrand—At Weston, the wife of T. Brand, a son.",
        "• harbours, tides and markets\n• gardens, mills and bridges\n— anchors, sails and ropes",
        "FURS! FURS! FURS!\nNO REASONABLE OFFER REFUSED\nApply Holm & Co.\nSold Everywhere.",
    ),
    "table": (
        "| Easton | 12.5 | 40.1 | 7.0 |\n| Weston | 18.0 | 3.2 | 66.1 |\n| Norton | 1.5 | 21.7 | 9.9 |",
        "Wheat, per ton ............... 52 6\nBarley, per cwt .............. 8 11\nWool, per doz ................ 31 0",
        "Holm 43 82 34 85\nBrand 79 23 75 63\nBerg 94 38 64 27",
        "Easton  7.40  8.12  9.30\nWeston  7.55  8.31  9.48\nNorton  8.04  8.47  10.02",
        "18  47°  29.06  W.  rain\n19  52°  29.80  N.W.  fine\n20  49°  28.91  calm  fog",
    ),
    "junk": (
        "* * * * *\n=====\n|  |   |\n~~~~~~~",
        "xkq zvwt bgh qjz\nwrtk pv zzx kqt hgfd\nqwv bnmx tkz zk",
        "rna st pr ha c c an n p\npa cti gh nd ar iele pa rri\nr d e t og l us ch res",
        "Holm Holm Holm Holm\nHolm Holm Holm\nHolm Holm Holm Holm Holm",
        "and and and und and\nand and  and amd\nand andand and and and",
        "pɹɐʍɹoɟ ǝɥʇ ɟo ʇno\nsɐʍ ʇı ʇɐɥʇ pɐǝɹ\nʎɐp ɹǝɥʇouɐ uo",
        "{[~ |<°, :[_>'\n=+/ ;`!> ]<.\n'(`)I. ^<:",
    ),
}


# Prose is also set in capitals; a page of another kind often opens with a little prose and a heading.
_OPENING = EXAMPLES["prose"][0] + "\nMARKETS.\n"
_OPENED = {k: tuple(_OPENING + "\n".join([t] * n) for t in texts for n in (2, 4)) for k, texts in EXAMPLES.items() if k != "prose"}
EXAMPLES = {k: texts + _OPENED.get(k, tuple(map(str.upper, texts))) for k, texts in EXAMPLES.items()}


def measure_texts(texts: pa.Array, common: pa.Array) -> list[np.ndarray]:
    """Word and line counts and ``FEATURES`` of texts, by column, with Arrow's kernels: no text is walked in Python.

    Words are runs of letters, tokens runs of what is not white space, lines those that are not blank.  A text without words or lines has zeros.
    """
    n = len(texts)
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    doc, flat = pc.list_parent_indices(split).to_numpy(), split.flatten()
    solid = pc.match_substring_regex(flat, r"\S").to_numpy(zero_copy_only=False)
    doc, lines = doc[solid], flat.filter(pa.array(solid))
    spelled = pc.split_pattern_regex(lines, r"\P{L}+")
    at, words = pc.list_parent_indices(spelled).to_numpy(), spelled.flatten()
    length = pc.utf8_length(words).to_numpy()
    at, words, length = at[length > 0], words.filter(pa.array(length > 0)), length[length > 0]
    known = pc.is_in(pc.utf8_lower(words), value_set=common).to_numpy(zero_copy_only=False)
    upper = pc.match_substring_regex(words, r"^\p{Lu}").to_numpy(zero_copy_only=False)
    has = lambda pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    count = lambda pattern: pc.count_substring_regex(lines, pattern).to_numpy()
    by_doc = lambda values: np.bincount(doc, weights=values, minlength=n)
    of_words = lambda values: np.bincount(doc[at], weights=values, minlength=n)
    n_lines, n_words = np.bincount(doc, minlength=n), np.bincount(doc[at], minlength=n)
    letters, signs, digits = of_words(length), by_doc(count(r"\S")), by_doc(count(r"[0-9]"))
    bare = np.bincount(at, weights=known, minlength=len(doc)) == 0
    share = lambda part, whole: np.divide(part, whole, out=np.zeros(n), where=np.asarray(whole) > 0)
    return [
        n_words, n_lines, share(letters, n_words), share(np.maximum(0, signs - letters - digits), signs), share(digits, signs), share(of_words(upper), n_words), share(by_doc(has(r"[.,;:!?\"']\s*$")), n_lines),
        share(of_words(known), n_words), share(by_doc(bare), n_lines), share(by_doc(has(r"^\s*\p{Ll}")), n_lines), share(by_doc(count(r"\S+")), n_lines), share(of_words(length == 1), n_words),
    ]


def word_list(common_words: DataFrame) -> list[str]:
    """The common words of all languages: a fixed table of a few hundred rows."""
    return sorted({r[0].lower() for r in common_words.where("word is not null").select("word").distinct().collect()})


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Statistics of every document's whole ``text``: ``doc_id``, word and line counts and ``FEATURES``.

    Symbol and digit ratios are shares of the characters that are not white space; ``line_end_share`` is the share of lines that end in
    punctuation, ``bare_line_share`` of those without a common word, ``lower_start_share`` of those that begin with a small letter; ``common_share`` is the share of words in
    ``common_words``, ``upper_ratio`` of those with a capital, ``single_share`` of those of one letter.  A null or empty
    text gives zeros.  Null ids give no row; of rows that share an id the smallest statistics count.
    """
    common = word_list(common_words)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(common, pa.string())
        for b in batches:
            found = measure_texts(b.column(1), known)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(found, _TYPES[1:]))], [n for n, _ in _TYPES])

    found = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(measure, STATISTICS_SCHEMA)
    names = [n for n, _ in _TYPES[1:]]
    return found.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("s")).select("doc_id", "s.*")


class Mixture:
    """A Gaussian mixture with full covariances over standardized statistics."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> None:
        self.center, self.scale, self.weights, self.means = center, scale, weights, means
        self.covariances = covariances + FLOOR * np.eye(len(center))
        lower = np.linalg.cholesky(self.covariances)
        self.whiten = np.linalg.inv(lower).transpose(0, 2, 1)
        self.log_scale = -np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1) - 0.5 * len(center) * np.log(2 * np.pi)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log density of rows under each component."""
        z = (x - self.center) / self.scale
        out = np.empty((len(x), len(self.means)))
        for j, (m, w) in enumerate(zip(self.means, self.whiten)):
            y = (z - m) @ w
            out[:, j] = self.log_scale[j] - 0.5 * np.einsum("ij,ij->i", y, y)
        return out

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(component probabilities, log likelihoods) of rows."""
        joint = self.log_density(x) + np.log(self.weights)
        top = joint.max(1, keepdims=True)
        e = np.exp(joint - top)
        s = e.sum(1, keepdims=True)
        return e / s, (top + np.log(s))[:, 0]

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected counts, sums and second moments of every component over rows, and their log likelihood."""
        p, logs = self.posterior(x)
        z = (x - self.center) / self.scale
        second = np.einsum("ik,ij,il->kjl", p, z, z, optimize=True)
        return np.hstack([p.sum(0)[:, None], p.T @ z, second.reshape(len(second), -1)]), float(logs.sum())

    def updated(self, total: np.ndarray) -> Mixture:
        """The mixture that the sums of all rows say."""
        d = len(self.center)
        mass = np.maximum(total[:, :1], 1e-9)
        means = total[:, 1 : 1 + d] / mass
        covariances = total[:, 1 + d :].reshape(-1, d, d) / mass[:, :, None] - np.einsum("kj,kl->kjl", means, means)
        return Mixture(self.center, self.scale, (mass / mass.sum())[:, 0], means, covariances)


def _start(sample: np.ndarray, k: int) -> np.ndarray:
    """Means spread over the sample: each next one is the row farthest from those before."""
    chosen = [int(np.argmin((sample**2).sum(1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def fit_mixture(statistics: DataFrame, k: int = COMPONENTS, tolerance: float = 1e-3) -> Mixture | None:
    """Expectation-maximization over all rows that have words, until a round raises their mean log likelihood by less than ``tolerance``; None if there are none.

    The likelihood never falls and is bounded, so the rounds end.  Each adds up the expected counts, sums and second moments of every component in the tasks; only these k x 111
    numbers reach the driver.  The start is fitted on a sample of bounded size, whatever the number of rows: one id hash in n / ``INIT_SAMPLE``.
    """
    rows = statistics.where("n_words > 0").select("doc_id", *FEATURES)
    moments = rows.select(*(x for f in FEATURES for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))), F.count("*").alias("n")).first()
    if not moments["n"]:
        return None
    center = np.array([moments[f"m_{f}"] for f in FEATURES])
    scale = np.maximum(np.array([moments[f"s_{f}"] for f in FEATURES]), 1e-3)
    share = max(1, moments["n"] // INIT_SAMPLE)
    sample = rows.withColumn("_h", F.xxhash64("doc_id")).where(F.pmod("_h", F.lit(share)) == 0).toPandas()
    sample = sample.sort_values(["_h", "doc_id"], kind="stable")[list(FEATURES)].to_numpy()
    if not len(sample):
        sample = center[None, :]
    z = (sample - center) / scale
    means = _start(z, min(k, len(np.unique(z, axis=0))))
    k, d = means.shape
    model = Mixture(center, scale, np.full(k, 1 / k), means, np.tile(0.5 * np.eye(d), (k, 1, 1)))
    model = _climb(model, lambda m: m.sums(sample), len(sample), tolerance / 10)

    def over_all(m: Mixture) -> tuple[np.ndarray, float]:
        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, like = np.zeros((k, 1 + d + d * d)), 0.0
            for pdf in batches:
                t, g = m.sums(pdf.to_numpy())
                total, like = total + t, like + g
            yield pd.DataFrame({"at": np.arange(total.size + 1), "v": np.append(total.ravel(), like)})

        v = rows.select(*FEATURES).mapInPandas(expect, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas()["v"].to_numpy()
        return v[:-1].reshape(k, -1), float(v[-1])

    return _climb(model, over_all, moments["n"], tolerance)


def _climb(model: Mixture, sums, n: int, tolerance: float) -> Mixture:  # noqa: ANN001
    before = -np.inf
    while True:
        total, like = sums(model)
        if like / n - before < tolerance:
            return model
        before, model = like / n, model.updated(total)


def name_components(model: Mixture, common: list[str]) -> list[str]:
    """The kind of each component: that of the inspected example nearest to its mean, by the covariance that pages have within components on average.

    Under a component's own covariance the likeliest example could be a far one: all examples lie in the tails of a broad component, and which is likeliest there says little.
    """
    kinds = np.array([k for k, texts in EXAMPLES.items() for _ in texts])
    found = measure_texts(pa.array([t for texts in EXAMPLES.values() for t in texts]), pa.array(common, pa.string()))
    within = np.linalg.inv(np.linalg.cholesky(np.einsum("k,kij->ij", model.weights, model.covariances))).T
    examples, means = (np.column_stack(found[2:]) - model.center) / model.scale @ within, model.means @ within
    return kinds[((means[:, None] - examples) ** 2).sum(2).argmin(1)].tolist()


KINDS = ("prose", "list", "table", "junk")


def classify(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id, kind, p_prose`` and the statistics of every document.

    ``kind`` is prose, list, table or junk: prose where the mixture's prose components have at least half of the probability, else the likeliest of the others.  A
    document without words is junk.
    """
    stats = cut(text_statistics(documents, common_words))
    model = fit_mixture(stats)
    names = np.array(name_components(model, word_list(common_words)) if model else [])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = model.posterior(pdf[list(FEATURES)].to_numpy(float))[0] if model else np.zeros((len(pdf), 0))
            by_kind = np.column_stack([p[:, names == k].sum(1) for k in KINDS])
            kind = np.where(by_kind[:, 0] >= 0.5, "prose", np.array(KINDS[1:])[by_kind[:, 1:].argmax(1)])
            wordy = pdf["n_words"].to_numpy() > 0
            yield pdf.assign(kind=np.where(wordy, kind, "junk"), p_prose=np.where(wordy, by_kind[:, 0], 0.0))

    return stats.mapInPandas(score, STATISTICS_SCHEMA + ", kind string, p_prose double")
