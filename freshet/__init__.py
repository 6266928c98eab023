"""Seasonal-forecast data operators as Spark DataFrame transformations.

Every public operator is a pure function ``DataFrame -> DataFrame`` (or
``Column -> Column`` for scalars).  See README.md for the layout and the size
rules each operator keeps.
"""

import sys

from pyspark import cloudpickle

# The few Python steps travel with their code, so executors need no copy of this
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
