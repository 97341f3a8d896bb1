"""riskloom: source-code risk analytics on Spark DataFrames.

Layers, lowest first:

* ``functions`` - Column -> Column expressions (paths, texts, scores, responses)
* ``operators`` - DataFrame -> DataFrame steps (metrics, imports, history, ...)
* ``plans``     - whole jobs built from the operators
* ``sources``   - readers and writers
* ``streaming`` - the same steps fed by Structured Streaming
"""

from riskloom.settings import Settings

__all__ = ["Settings"]
