"""Import every catalogue module so its queries register."""

from loghawk.plans import catalog_log  # noqa: F401
from loghawk.plans import catalog_classify  # noqa: F401
from loghawk.plans import catalog_graph  # noqa: F401
from loghawk.plans import catalog_model  # noqa: F401
from loghawk.plans import catalog_stream  # noqa: F401
from loghawk.plans import catalog_io  # noqa: F401
