"""Climate series and extreme-event analytics as plain Spark DataFrame functions.

Sub-packages:

* ``functions``  – column expressions (dates, coordinates, seasons, event and alert rules)
* ``sources``    – readers and writers
* ``operators``  – DataFrame -> DataFrame operators
* ``plans``      – whole jobs composed from the operators
* ``streaming``  – the same rules on Structured Streaming
"""
