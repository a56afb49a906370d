"""tidecast — probabilistic panel forecasting and evaluation as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or ``Column -> Column``)
whose grouping keys are parameters.  Nothing holds data between calls; Catalyst plans
each job and the library only chooses plan *shapes* (which keys to shuffle on, what
to pre-aggregate, what may be broadcast after a size check).
"""

__version__ = "0.1.0"
