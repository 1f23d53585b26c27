"""Column-expression builders (JVM-side, whole-stage-codegen friendly)."""

from loghawk.functions.columns import *  # noqa: F401,F403
