"""Words of many texts at once as numpy arrays (operators/wordarrays), by the operators' name."""

from siltstone.operators.wordarrays import _BYTE, _INV, _POW, _RUN, BLOCK, BY_LETTER, BY_SPACE, U, mix, run_hashes, shingle_sets, short_hash, span_hashes, spans

__all__ = ["BLOCK", "BY_LETTER", "BY_SPACE", "U", "_BYTE", "_INV", "_POW", "_RUN", "mix", "run_hashes", "shingle_sets", "short_hash", "span_hashes", "spans"]
