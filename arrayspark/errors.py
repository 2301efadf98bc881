"""Error codes with their messages, for callers that keep codes: ``ArrayError.code`` is one of them."""

from __future__ import annotations

from .meta import ArrayError

# fixed values: the names of what can fail, and what each is called in a message
SUBJECTS = {
    "CONTAINER": "CONTAINER",
    "DTSHAPE": "DTSHAPE",
    "SHAPE": "SHAPE",
    "CHUNKSHAPE": "CHUNK SHAPE",
    "NDIM": "NUMBER OF DIMENSIONS",
    "DTYPE": "DATA TYPE",
    "STORAGE": "STORAGE",
    "PERSISTENCY": "PERSISTENCY",
    "BUFFER": "BUFFER",
    "ASSERTION": "ASSERTION",
    "BLOCKSHAPE": "BLOCK SHAPE",
    "RNG_METHOD": "RANDOM GENERATOR METHOD",
    "RAND_METHOD": "RANDOM METHOD",
    "RAND_PARAM": "RANDOM PARAM",
    "ITER": "ITERATOR",
    "EVAL_METHOD": "EVALUATION METHOD",
    "EVAL_ENGINE": "EVALUATION ENGINE",
    "NCORES": "NUMBER OF CORES",
    "CACHE_SIZES": "CACHE SIZES",
}

#: How a subject fails, by the part of a code before or after it.
_REASONS = {"EMPTY": "is empty", "FULL": "is full", "INVALID": "is invalid", "TOO_SMALL": "is too small", "FAILED": "failed", "NOT_COMPILED": "isn't compiled", "OUT_OF_RANGE": "is out of range"}

_PAIRS = [
    ("INVALID", s) for s in ("DTSHAPE", "DTYPE", "SHAPE", "CHUNKSHAPE", "BLOCKSHAPE", "NDIM", "RNG_METHOD", "RAND_METHOD", "RAND_PARAM", "EVAL_METHOD", "EVAL_ENGINE", "STORAGE")
] + [("EMPTY", "CONTAINER"), ("FULL", "CONTAINER"), ("TOO_SMALL", "BUFFER")]

MESSAGES = {f"{reason}_{subject}": f"{SUBJECTS[subject]} {_REASONS[reason]}" for reason, subject in _PAIRS} | {
    f"{subject}_{reason}": f"{SUBJECTS[subject]} {_REASONS[reason]}"
    for subject, reason in (("EVAL_ENGINE", "FAILED"), ("EVAL_ENGINE", "NOT_COMPILED"), ("EVAL_ENGINE", "OUT_OF_RANGE"), ("RAND_METHOD", "FAILED"), ("ASSERTION", "FAILED"))
} | {
    "INVALID_AXIS": "AXIS is invalid",
    "INVALID_ITERSHAPE": "ITERATOR'S SHAPE is invalid",
    "GET_NCORES": "NUMBER OF CORES can't be read",
    "GET_CACHE_SIZES": "CACHE SIZES can't be read",
    "END_ITER": "ITERATOR has ended",
    "NOT_END_ITER": "ITERATOR hasn't ended",
    "INVALID_ARGUMENT": "an argument that the operation doesn't accept",
    "READ_ONLY_VIEW": "a view can't be written",
    "FILE_NOT_EXIST": "nothing is stored there",
    "NOT_IMPLEMENTED": "an operation without a definition",
}


def strerror(code: str | ArrayError) -> str:
    """The message of a code, or of an error's code."""
    code = code.code if isinstance(code, ArrayError) else code
    try:
        return MESSAGES[code]
    except KeyError:
        raise ArrayError(f"no error code {code}") from None
