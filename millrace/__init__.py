"""millrace: data-preparation, model-evaluation and text-corpus analytics as Spark jobs.

Every operator is a function from DataFrame to DataFrame. Nothing here starts a
session: the caller passes one, with its own settings.
"""

import sys

from pyspark import cloudpickle

# Python UDFs travel to the executors by value, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
