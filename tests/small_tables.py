"""Where the small driver tables lie."""

SF_SMALL = "/root/testdata/sf0.001"
