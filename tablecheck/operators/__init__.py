"""The checks. `*_measurement` builds a lazy measurement, `check_*` its one-row
result, `*_rows` the rows that break the check."""
