"""Count and metric columns. Undefined metrics are NULL and leave every mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tn")
METRICS = ("precision", "recall", "f1", "iou", "fpr")


def confusion(pred: Column, label: Column, prefix: str = "") -> list[Column]:
    """tp/fp/fn/tn plus ignored (NULL label) as mergeable aggregates."""
    hit, miss = pred, ~pred
    return [
        F.count_if(hit & (label == 1)).alias(prefix + "tp"),
        F.count_if(hit & (label == 0)).alias(prefix + "fp"),
        F.count_if(miss & (label == 1)).alias(prefix + "fn"),
        F.count_if(miss & (label == 0)).alias(prefix + "tn"),
        F.count_if(label.isNull()).alias(prefix + "ignored"),
    ]


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def _terms():
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    return tp, fp, fn, tn, tp + fn, tp + fp


def visible_metrics(hypothesis: Column) -> dict[str, Column]:
    """Case policy: P/R/F1/IoU only for visible H1, FPR only for H0."""
    tp, fp, fn, tn, positives, marked = _terms()
    shown = (hypothesis == "H1") & (positives > 0)
    return {
        "f1": F.when(shown, 2 * tp / (2 * tp + fp + fn)),
        "iou": F.when(shown, tp / (tp + fp + fn)),
        "precision": F.when(shown, F.coalesce(ratio(tp, marked), F.lit(0.0))),
        "recall": F.when(shown, tp / positives),
        "fpr": F.when(hypothesis == "H0", ratio(fp, fp + tn)),
    }


def plain_metrics() -> dict[str, Column]:
    """Map policy: every ratio where defined; precision 0 when all positives are missed."""
    tp, fp, fn, tn, positives, marked = _terms()
    return {
        "precision": F.when(marked > 0, tp / marked).when(fn > 0, F.lit(0.0)),
        "recall": ratio(tp, positives),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "iou": ratio(tp, tp + fp + fn),
        "fpr": ratio(fp, fp + tn),
        "marked_fraction": ratio(marked, tp + fp + fn + tn),
    }


def zero_metrics() -> dict[str, Column]:
    """Fusion policy: a zero denominator counts as 0."""
    tp, fp, fn, _, positives, marked = _terms()
    zero = lambda top, bottom: F.coalesce(ratio(top, bottom), F.lit(0.0))
    return {
        "precision": zero(tp, marked),
        "recall": zero(tp, positives),
        "f1": zero(2 * tp, 2 * tp + fp + fn),
        "iou": zero(tp, tp + fp + fn),
    }


PAIR_COUNTS = tuple(
    f"{kind}_{where}"
    for kinds in (("tp", "tp", "tp", "fn"), ("fp", "fp", "fp", "tn"))
    for kind, where in zip(kinds, ("both", "a_only", "b_only", "neither"))
)


def pair_counts(a: Column, b: Column, label: Column) -> list[Column]:
    """Eight cells: what two predictors mark together, alone or not at all."""
    masks = (a & b, a & ~b, ~a & b, ~a & ~b)
    cells = [(target, mask) for target in (1, 0) for mask in masks]
    return [
        F.count_if(mask & (label == target)).alias(name) for name, (target, mask) in zip(PAIR_COUNTS, cells)
    ]


def recall_rates(hypothesis: Column) -> dict[str, Column]:
    """Fourteen rates of a gate ``a`` over a baseline ``b`` from the eight cells."""
    c = {name: F.col(name) for name in PAIR_COUNTS}
    h1, h0 = hypothesis == "H1", hypothesis == "H0"
    positives = c["tp_both"] + c["tp_a_only"] + c["tp_b_only"] + c["fn_neither"]
    negatives = c["fp_both"] + c["fp_a_only"] + c["fp_b_only"] + c["tn_neither"]
    found = c["tp_both"] + c["tp_b_only"]
    lost, rejected = F.when(h1, ratio(c["tp_b_only"], positives)), F.when(h1, ratio(c["tp_b_only"], found))
    removed_h0 = F.when(h0, ratio(c["fp_b_only"], negatives))
    return {
        "baseline_recall": F.when(h1, ratio(found, positives)),
        "confirmed_recall": F.when(h1, ratio(c["tp_both"], positives)),
        "lost_recall": lost,
        "rejected_tp_fraction": rejected,
        "retained_tp_fraction": 1 - rejected,
        "added_recall": F.when(h1, ratio(c["tp_a_only"], positives)),
        "rescued_misses": F.when(h1, ratio(c["tp_a_only"], c["tp_a_only"] + c["fn_neither"])),
        "added_precision_h1": F.when(h1, ratio(c["tp_a_only"], c["tp_a_only"] + c["fp_a_only"])),
        "extra_h1_fpr": F.when(h1, ratio(c["fp_a_only"], negatives)),
        "extra_h0_fpr": F.when(h0, ratio(c["fp_a_only"], negatives)),
        "removed_h1_fpr": F.when(h1, ratio(c["fp_b_only"], negatives)),
        "removed_h0_fpr": removed_h0,
        "and_lost_recall": lost,
        "and_removed_h0_fpr": removed_h0,
    }
