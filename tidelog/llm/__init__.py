"""Training-data operators: documents, web pages and chats at corpus scale.

Nothing outside this folder imports it. Functions that run on executors are
pickled by value, so a cluster needs the third-party libraries only, not this
package, on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
