"""Where the tests find the smallest given tables."""

SF = "/root/testdata/sf0.001"
