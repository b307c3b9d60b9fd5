"""ebbflow: subscription-retention analytics expressed as Spark DataFrame jobs.

Every public operator is a plain ``DataFrame -> DataFrame`` function built on
Catalyst expressions, joins, aggregates and windows.  Nothing is processed on the
driver except fixed-size results (a 19-row threshold sweep, two tercile edges,
a handful of population scalars).
"""

__version__ = "0.1.0"
