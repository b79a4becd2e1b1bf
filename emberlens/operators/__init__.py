"""DataFrame operators by family of evidence; each returns hits and coverage together."""
