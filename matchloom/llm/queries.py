"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from . import ann, langid, lm, mixing, pii, simhash, sketch, tokens, toxicity
from .common import table


def op1_ann_search(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark, sf_dir):
    return sketch.edited(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark, sf_dir):
    return tokens.bpe_round_trip(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return langid.languages(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ann_search, op2_fingerprints, op3_token_counts, op4_simhash, op5_toxicity, op6_personal_data, op7_bpe_round_trip, op8_language_id, op9_lm_scores, op10_mixing)}

#: DuckDB SQL of those that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {}
