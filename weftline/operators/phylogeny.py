"""Ancestral states of alignment columns on a tree with a rate model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Node(NamedTuple):
    """A node of a tree: its name, the length of the branch to it, its children."""

    label: str
    length: float
    children: tuple["Node", ...]


def parse_newick(text: str) -> Node:
    """A tree from its bracket notation; names and lengths may be left out."""
    tokens = re.findall(r"[(),;]|:[^(),;]+|[^(),:;]+", text.strip())
    at = 0

    def node() -> Node:
        nonlocal at
        children: list[Node] = []
        if tokens[at] == "(":
            at += 1
            children.append(node())
            while tokens[at] == ",":
                at += 1
                children.append(node())
            if tokens[at] != ")":
                raise ValueError("unbalanced brackets")
            at += 1
        label, length = "", 0.0
        if at < len(tokens) and tokens[at] not in "(),;" and not tokens[at].startswith(":"):
            label, at = tokens[at].strip(), at + 1
        if at < len(tokens) and tokens[at].startswith(":"):
            length, at = float(tokens[at][1:]), at + 1
        return Node(label, length, tuple(children))

    return node()


def expm(q: np.ndarray) -> np.ndarray:
    """The exponential of a small matrix by scaling and squaring."""
    norm = float(np.abs(q).sum(axis=1).max())
    squarings = max(0, int(np.ceil(np.log2(norm))) + 4) if norm > 0 else 0
    x, term = q / 2**squarings, np.eye(len(q))
    out = term.copy()
    for k in range(1, 20):
        term = term @ x / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


class TreeModel(NamedTuple):
    """An alphabet, the frequencies of its letters, the rate matrix and the tree."""

    alphabet: str
    background: list[float]
    matrix: list[list[float]]
    tree: Node

    @classmethod
    def parse(cls, text: str) -> "TreeModel":
        """From the text of a model file with the sections ALPHABET, BACKGROUND, RATE_MAT and TREE."""
        body = {m[1]: m[2].strip() for m in re.finditer(r"^([A-Z_]+):\s*(.*?)(?=^[A-Z_]+:|\Z)", text, re.S | re.M)}
        alphabet = re.sub(r"\s+", "", body["ALPHABET"])
        rates = [float(x) for x in body["RATE_MAT"].split()]
        n = len(alphabet)
        return cls(alphabet, [float(x) for x in body["BACKGROUND"].split()], [rates[k * n : k * n + n] for k in range(n)], parse_newick(body["TREE"]))


    def text(self) -> str:
        """A model file of these sections, as ``parse`` reads it."""
        numbers = lambda row: " ".join(repr(float(x)) for x in row)
        rates = "\n".join(numbers(row) for row in self.matrix)
        return f"ALPHABET: {' '.join(self.alphabet)}\nBACKGROUND: {numbers(self.background)}\nRATE_MAT:\n{rates}\nTREE: {newick(self.tree)};\n"


def newick(node: Node) -> str:
    """A tree in bracket notation, all lengths but the root's given."""
    inner = f"({','.join(f'{newick(c)}:{c.length!r}' for c in node.children)})" if node.children else ""
    return inner + node.label


def scaled(node: Node, by: float) -> Node:
    """A tree with all branches ``by`` times as long."""
    return Node(node.label, node.length * by, tuple(scaled(c, by) for c in node.children))


def gap_rates(background: list[float], kappa: float, gap: float, alphabet: str = "ACGT-") -> list[list[float]]:
    """Rates of change between the letters of an alphabet of bases and the gap: as frequent as what is changed to, ``kappa`` times so between A and G
    and between C and T, ``gap`` times so to and from the gap; scaled so that a branch of length 1 has one change at a place on average."""
    pi, n = np.array(background), len(alphabet)
    q = np.zeros((n, n))
    for i, a in enumerate(alphabet):
        for j, b in enumerate(alphabet):
            if i != j:
                q[i, j] = pi[j] * (kappa if a + b in ("AG", "GA", "CT", "TC") else gap if "-" in (a, b) else 1.0)
    q[np.arange(n), np.arange(n)] = -q.sum(axis=1)
    return (q / -(pi * np.diag(q)).sum()).tolist()


class Fit(NamedTuple):
    """A fitted model and how it was found: ``(step, log_likelihood, scale, kappa, gap)`` of each step."""

    model: TreeModel
    trace: list[tuple[int, float, float, float, float]]


def log_likelihoods(columns: DataFrame, models: list[TreeModel], species: list[str], key: str = "key") -> list[float]:
    """For each of some models the log likelihood of the columns ``(key, count)``, by pruning, in one pass: each task adds up its columns, so what is
    gathered is one number for each model. A column with a character that no alphabet has, or of which nothing is seen, tells nothing and is left out."""
    steps = [{t: expm(np.array(m.matrix) * t) for t in _lengths(m.tree)} for m in models]
    alphabet = models[0].alphabet

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(models))
        for pdf in parts:
            if not len(pdf):
                continue
            leaves, seen = _observed(pdf[key], species, alphabet)
            counts = pdf["count"].to_numpy(float)
            for k, m in enumerate(models):
                lik, known = _likelihood(m.tree, leaves, seen, steps[k])
                mass = (lik * np.array(m.background)).sum(axis=1)
                good = known & (mass > 0)
                sums[k] += float((counts[good] * np.log(mass[good])).sum())
        yield pd.DataFrame({"k": np.arange(len(models)), "s": sums})

    found = columns.select(key, "count").mapInPandas(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()  # a row for each model
    return [s for _, s in sorted((r.k, r.s) for r in found)]


def fit_model(columns: DataFrame, tree: Node, species: list[str], alphabet: str = "ACGT-", start: tuple[float, float, float] = (1.0, 2.0, 1.0), steps: int = 60, tolerance: float = 1e-3, most: float = 64.0) -> Fit:
    """The model (``gap_rates`` over ``tree``, its branches scaled alike) under which columns ``(key, count)`` are likeliest: the frequencies of letters are those
    of the columns; the scale, ``kappa`` and ``gap`` are looked for by steps.

    Each step works out the likelihoods of the 26 models around the best one so far, whose parameters are a factor larger, as large or smaller, in one pass over the
    distinct columns; the best of them is the next, and where none is better the factor comes nearer to 1 (its root), until it is within ``tolerance``. So the
    likelihood never falls. Parameters stay between 1 / ``most`` and ``most``; without columns the start is the result."""
    each = columns.select("count", F.explode(F.split(F.upper("key"), "")).alias("c")).groupBy("c").agg(F.sum("count").alias("n")).collect()  # a row for each letter
    n = {r.c: r.n for r in each if r.c and r.c in alphabet}
    total = sum(n.values())
    background = [n.get(a, 0) / total if total else 1 / len(alphabet) for a in alphabet]

    def model(at: tuple[float, float, float]) -> TreeModel:
        return TreeModel(alphabet, background, gap_rates(background, at[1], at[2], alphabet), scaled(tree, at[0]))

    best, factor = start, 2.0
    trace: list[tuple[int, float, float, float, float]] = []
    if total:
        trace.append((0, log_likelihoods(columns, [model(best)], species)[0], *best))
    for step in range(1, steps + 1 if total else 0):
        around = {tuple(min(most, max(1 / most, p * factor**d)) for p, d in zip(best, ds, strict=True)) for ds in product((-1, 0, 1), repeat=3)} - {best}
        tried = sorted(around)
        found = log_likelihoods(columns, [model(t) for t in tried], species)
        k = int(np.argmax(found))
        if found[k] > trace[-1][1]:
            best = tried[k]
            trace.append((step, found[k], *best))
        elif factor - 1 < tolerance:
            break
        else:
            factor = factor**0.5
    return Fit(model(best), trace)


def _observed(keys: pd.Series, species: list[str], alphabet: str) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """For each species which letter each column has (no letter: none), and where something is seen."""
    texts = keys.str.upper().str.replace("N", "*").tolist()
    leaves, seen = {}, {}
    for k, s in enumerate(species):
        chars = np.array([t[k] if len(t) > k else "?" for t in texts])
        leaves[s] = (chars[:, None] == np.array(list(alphabet))[None, :]).astype(float)
        seen[s] = chars != "*"
    return leaves, seen


def _likelihood(node: Node, leaves: dict[str, np.ndarray], seen: dict[str, np.ndarray], steps: dict[float, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods (columns x states) below a node, and for which columns something is seen there."""
    if not node.children:
        some = next(iter(leaves.values()))  # a leaf without a character is not seen
        return leaves.get(node.label, some), seen.get(node.label, np.zeros(len(some), bool))
    total, known = None, None
    for child in node.children:
        below, some = _likelihood(child, leaves, seen, steps)
        part = np.where(some[:, None], below @ steps[child.length].T, 1.0)
        total = part if total is None else total * part
        known = some if known is None else known | some
    return total, known


def _lengths(node: Node) -> set[float]:
    return {node.length}.union(*(_lengths(c) for c in node.children))


def ancestral_distributions(columns: DataFrame, model: TreeModel, species: list[str], key: str = "key") -> DataFrame:
    """``columns`` with ``p``: the distribution of states at the root given each column (a character for
    each of ``species``), by pruning. ``N`` and wildcards are not seen; a column of which nothing is
    seen, or with a character that is not of the alphabet, has none (null).

    Transition matrices are computed once for each branch length; columns go in batches.
    """
    q = np.array(model.matrix)
    steps = {t: expm(q * t) for t in _lengths(model.tree)}
    alphabet, background = model.alphabet, np.array(model.background)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                leaves, seen = _observed(pdf[key], species, alphabet)
                lik, known = _likelihood(model.tree, leaves, seen, steps)
                post = lik * background
                mass = post.sum(axis=1)
                good = known & (mass > 0)
                pdf["p"] = [(r / m).tolist() if g else None for r, m, g in zip(post, mass, good, strict=True)]
            else:
                pdf["p"] = []
            yield pdf

    return columns.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema) + ", p array<double>")


def all_columns(spark, model: TreeModel, species: list[str]) -> DataFrame:  # noqa: ANN001
    """Distributions for every possible column of the alphabet."""
    from .columns import column_space

    words = column_space(spark, len(species), alphabet=model.alphabet).select("key")
    return ancestral_distributions(words, model, species).withColumn("count", F.lit(None).cast("long"))
