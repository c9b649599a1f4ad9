"""What several test modules share. Not in conftest.py, as a folder below may
have one of its own and only one of them can be imported by that name."""

SF_SMALL = "/root/testdata/sf0.001"
TRIALS = 6  # of the registered search, in place of its 50
