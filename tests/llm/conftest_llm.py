"""What several tests share."""

SF = "/root/testdata/sf0.001"


def rows(frame):
    return [r.asDict() for r in frame.collect()]
