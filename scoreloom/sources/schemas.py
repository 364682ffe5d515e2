"""Declared schemas; nothing is inferred."""

from __future__ import annotations

_COMMON = "index int, grade int, mode string, item string, sqid string"

RAW = {
    "bw": f"{_COMMON}, sc string, text string",
    "math": f"{_COMMON}, sc string, text string",
    "fw": f"{_COMMON}, con string, dev string, org string, text string",
}
_SCORE = "score int, min_score int, max_score int, score_norm double"
CLEAN = {
    "bw": f"index int, grade int, mode string, text string, section string, {_SCORE}",
    "math": f"index int, grade int, mode string, text string, {_SCORE}",
    "fw": "index int, grade int, mode string, text string, "
    + ", ".join(f"{t} struct<score:int,min_score:int,max_score:int,score_norm:double>"
                for t in ("con", "dev", "org")),
}
AGREEMENT = "item int, qwk_hh double"
TRAIT_AGREEMENT = "item int, trait string, qwk_hh double"
PREDICTIONS = "idx bigint, score int, pred int"
METRICS = "metric string, value double, step bigint"
