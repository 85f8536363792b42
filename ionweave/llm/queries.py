"""Registers the queries of this subpackage."""
from __future__ import annotations

from ionweave.llm import curves, idcoder, licences, linededup, mixing, neardup, packing, periods, prints, repair, secrets, topk, toxicity  # noqa: F401
from ionweave.llm.base import ORACLES, QUERIES  # noqa: F401
