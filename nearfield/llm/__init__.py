"""Training-data operators: token counts, line dedup, packing, toxicity, page text, substring,
embedding and SimHash near-dedup, URL filters and benchmark decontamination.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

#: Python stages carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
