"""maillake: mail analytics on Spark.

Mailboxes are read as splittable Spark sources (``maillake.sources``), parsed
with Column expressions (``maillake.functions``) into a star schema, and
analysed with DataFrame operators (``maillake.operators``).  Ordered work,
registered queries and reports live in ``maillake.plans``; writers in
``maillake.sinks``; Structured Streaming jobs in ``maillake.streaming``.
"""

__version__ = "0.1.0"
