import os

SF = os.environ.get("TEST_ORACLE_SF_DIR", "/root/testdata/sf0.01")
