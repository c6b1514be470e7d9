"""webloom: question answering over collected web pages, as Spark DataFrame jobs.

Every public operator is a DataFrame -> DataFrame function: no actions inside
(except where a documented scalar size statistic is needed), no global state,
parameters carrying the defaults of the behaviour being reproduced.
"""

__all__ = ["session", "constants"]
