"""Independent SQL for every operator, run by the checking engine on the same files.

The statements join and count row by row, as the reports are defined; the operators
aggregate first. Divisions are done on integers, half-up, so both sides agree to the digit.
"""
