"""Dimensions of the semantic instruction set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semantic operations in their stable numeric order.
SEMANTIC = (
    "Nop", "PrepareKeywordCall", "LoadConst", "LoadLiteral", "LoadLocal", "StoreLocal", "DeleteLocal", "LoadLocalPair", "StoreLocalPair", "StoreLoadLocal", "LoadGlobal",
    "StoreGlobal", "DeleteGlobal", "LoadAttribute", "StoreAttribute", "LoadElement", "StoreElement", "DeleteElement", "StoreCollectionElement", "ImportModule", "ImportAttribute",
    "EnterContext", "CreateFunction", "SetFunctionAttribute", "Call", "Marker", "StackCopy", "StackSwap", "StackRotate", "Pop", "Branch", "ConditionalBranch", "Return", "Raise", "Generic",
    "Suspend", "Unsupported", "BuildCollection", "UnpackCollection", "Yield",
)
SUSPENSIONS = ("Suspend", "Yield")
TERMINATORS = ("Return", "Raise", "Branch", "ConditionalBranch", *SUSPENSIONS)
NEVER_RAISE = ("Nop", "PrepareKeywordCall", "LoadConst", "LoadLiteral", "Marker", "StackCopy", "StackSwap", "StackRotate", "Pop", "Branch", "Return")
EDGE_KINDS = ("Fallthrough", "BranchTrue", "BranchFalse", "Jump", "Exception", "Resume")
OUTCOMES = {"Fallthrough": "Normal", "Jump": "Normal", "BranchTrue": "True", "BranchFalse": "False", "Exception": "Exception", "Resume": "Resume"}


def may_raise(op: Column) -> Column:
    return ~op.isin(*NEVER_RAISE)


def is_terminator(op: Column) -> Column:
    return op.isin(*TERMINATORS)


def is_suspension(op: Column) -> Column:
    return op.isin(*SUSPENSIONS)


def outcome(kind: Column) -> Column:
    """Branch outcome of an edge kind."""
    return F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])[kind]
