"""Reading source trees and writing and reading the tables of a program graph."""
