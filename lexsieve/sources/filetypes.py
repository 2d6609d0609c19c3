"""File types by name, as public line-search tools list them: a compact table, `name extensions / exact names`.  A star stands for any ending."""

from __future__ import annotations

_TABLE = """
agda agda lagda
aidl aidl
amake mk bp
asciidoc adoc asc asciidoc
asm asm s S
avro avdl avpr avsc
awk awk
bazel bzl / BUILD BUILD.bazel WORKSPACE WORKSPACE.bazel
bitbake bb bbappend bbclass conf inc
c c h H
cabal cabal
cbor cbor
ceylon ceylon
clojure clj cljc cljs cljx
cmake cmake / CMakeLists.txt
coffeescript coffee
config cfg conf config ini
cpp cpp cc cxx c++ hpp hh hxx h++ h inl
crystal cr
cs cs
csharp cs
css css scss sass less
csv csv
cuda cu cuh
cython pyx pxd pxi
d d di
dart dart
dhall dhall
docker dockerfile / Dockerfile
elixir ex exs
elm elm
erb erb
erlang erl hrl
fish fish
fortran f F f77 f90 F90 f95 f03 for fpp
fsharp fs fsi fsx
gn gn gni
go go
gradle gradle
graphql graphql graphqls gql
groovy groovy gradle
h h hpp hh hxx
haml haml
haskell hs lhs cabal
hbs hbs
hs hs lhs
html html htm xhtml
idris idr lidr
java java
jinja j2 jinja jinja2
js js mjs cjs jsx
json json jsonl geojson
jsonl jsonl
julia jl
jupyter ipynb
kotlin kt kts
less less
license  / LICENSE LICENSE.* LICENCE LICENCE.* COPYING COPYING.*
lisp el lisp lsp cl fasl
lock lock / package-lock.json yarn.lock Cargo.lock Gemfile.lock
log log
lua lua
m4 m4
make mk mak / Makefile makefile GNUmakefile
mako mako mao
markdown md markdown mdown mkdn
md md markdown
nim nim nimble
nix nix
objc m mm
objcpp mm
ocaml ml mli mll mly
org org
pascal pas dpr lpr pp inc
perl pl pm t psgi
php php phtml php3 php4 php5 php7 phps
pod pod
protobuf proto
ps ps1 psm1 psd1
puppet pp erb
py py pyi
python py pyi
qmake pro pri
r r R Rmd Rnw
rdoc rdoc
readme  / README README.*
robot robot
rst rst
ruby rb gemspec / Gemfile Rakefile
rust rs
sass sass scss
scala scala sbt
sh sh bash zsh fish / .bashrc .zshrc .bash_profile
slim slim
smarty tpl
sml sml sig fun
solidity sol
sql sql
stylus styl
sv v sv svh svi
svg svg
swift swift
swig i swg
tcl tcl
terraform tf tfvars
tex tex ltx cls sty bib
textile textile
thrift thrift
toml toml
ts ts tsx mts cts
txt txt
typescript ts tsx mts cts
vala vala
vb vb
verilog v sv svh
vhdl vhd vhdl
vim vim
vue vue
webidl idl webidl widl
wiki mediawiki wiki
xml xml xsl xslt xsd wsdl svg plist
yaml yaml yml
zig zig
"""


def _parse() -> dict[str, list[str]]:
    types = {}
    for line in _TABLE.strip().splitlines():
        endings, _, exact = line.partition(" / ")
        name, *endings = endings.split()
        types[name] = [f"*.{e}" for e in endings] + exact.split()
    return types


#: name -> globs
FILE_TYPES = _parse()
