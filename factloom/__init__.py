"""factloom: evidence-bound record analytics as plain Spark jobs.

Every public function takes and returns a DataFrame, takes its reference time as a parameter and keeps
no session of its own.
"""
