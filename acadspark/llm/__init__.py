"""Operators for building training corpora (near-duplicates, decontamination, packing, ...).

``queries()`` and ``oracle_sql()`` list the registered queries of this
subpackage. Nothing else in the library imports it.
"""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this subpackage with each task, so a
# cluster needs no copy of the library on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def queries():
    from .catalog import queries as listed
    return listed()


def oracle_sql():
    from .catalog import oracle_sql as listed
    return listed()
